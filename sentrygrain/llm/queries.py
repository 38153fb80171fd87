"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, exact, language, lines, minhash, packing, pieces, quality, secrets, spelling, suffixes, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


QUALITY_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents
),
w as (select doc_id, len(words) as n, words, unnest(range(len(words) - 7)) as i from d where len(words) >= 8),
v as (select doc_id, i, n, array_to_string(words[i + 1:i + 8], ' ') as win from w),
c as (select doc_id, i, count(*) over (partition by doc_id, win) as times from v),
r as (select doc_id, count(distinct i + k) as n_repeat_words from c, (select unnest(range(8)) as k) where times > 1 group by doc_id),
m as (
  select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join r using (doc_id)
),
f as (
  select *, (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when 2 * n_symbols > n_words then 4 else 0 end) + (case when 2 * n_dup_lines > n_lines and n_dup_lines >= 4 then 8 else 0 end)
    + (case when 2 * word_chars < 3 * n_words then 16 else 0 end) + (case when word_chars > 25 * n_words then 32 else 0 end) as failed_bits
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed_bits,
  failed_bits & 3 <> 0 as base_failed, failed_bits = 0 as kept
from f
"""


@query("op4_quality_rules", QUALITY_SQL)
def _(spark, folder):
    return quality.quality(documents(spark, folder))


EXACT_SQL = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain, length(coalesce(text, '')) as chars
  from documents
),
g as (
  select doc_id, sha256(plain) as text_sha256, count(*) over (partition by plain) as group_size,
    first_value(doc_id) over (partition by plain order by chars desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""


@query("op5_exact_dedup", EXACT_SQL)
def _(spark, folder):
    return exact.exact(documents(spark, folder))


@query("op6_packing")
def _(spark, folder):
    return packing.pack(documents(spark, folder))


@query("op7_secret_scans")
def _(spark, folder):
    return secrets.secrets(documents(spark, folder))


@query("op2_minhash_near_dedup")
def _(spark, folder):
    return minhash.near(documents(spark, folder), width=3, percent=85)


@query("op10_line_dedup")
def _(spark, folder):
    return lines.report(documents(spark, folder))


@query("op1_suffix_array_dedup")
def _(spark, folder):
    return suffixes.dedup(documents(spark, folder))


@query("op9_substring_dedup")
def _(spark, folder):
    return automata.dedup(documents(spark, folder))


@query("op8_language_id")
def _(spark, folder):
    return language.identify(documents(spark, folder))


@query("op3_sentencepiece_sampling")
def _(spark, folder):
    return pieces.sampled(documents(spark, folder))


#: crc32, bit by bit, for the SQL below.
CRC_TABLE = """
crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from range(256) r(i)
)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``, beside the row of crc_table."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


SPELLING_SQL = rf"""
with recursive {CRC_TABLE},
runs as (
  select coalesce(doc_id::varchar, '') as own,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
),
counted as (select own, run, count(*) as times, own || ':' || run as keyed from runs where length(run) >= 6 group by all),
hashed as (select run, times, {crc_sql("keyed")} as h from counted, crc_table),
w as (
  select word, sum(times)::bigint as n
  from (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed)
  where length(word) >= 6 group by word having sum(times) >= 5
),
-- one byte a letter, since the distance counts bytes
p as (
  select word, n, length(word) as l,
    translate(word, (select string_agg(chr(i::int), '' order by i) from range(192, 256) r(i)), (select string_agg(chr(i::int), '' order by i) from range(32, 96) r(i))) as plain
  from w
),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from p a join p b on b.l between a.l - 1 and a.l + 1 and a.word <> b.word
  where levenshtein(a.plain, b.plain) = 1
),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
f as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n
  from w left join best using (word)
),
walk as (
  select word, form as last, 1 as step from f where form is not null
  union all
  select walk.word, f.form, step + 1 from walk join f on f.word = walk.last where f.form is not null
),
ends as (select word, arg_max(last, step) as root from walk group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from f left join ends using (word)
"""


@query("op11_spelling_variants", SPELLING_SQL)
def _(spark, folder):
    return spelling.variants(documents(spark, folder))


TRIE_SQL = rf"""
with {CRC_TABLE},
own as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first) as ts
  from conversations where conv_id is not null group by conv_id
),
h as (select conv_id, ts, conv_id - conv_id % 20 as base, ({crc_sql("conv_id::varchar")} % 4)::int as h from own, crc_table),
c as (
  select h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), case when len(h.ts) > h.h then h.ts[h.h + 1:] else [] end) as ts
  from h left join own b on b.conv_id = h.base
),
p as (select conv_id, d, len(ts) as n, ts[1:d] as path from (select *, unnest(range(len(ts) + 1)) as d from c)),
node as (
  select path, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
  from p group by path, d
),
kid as (select path[1:d - 1] as path, d - 1 as d, count(*) as n from node where d > 0 group by all),
own_sum as (
  select node.*, coalesce(kid.n, 0) as n_children,
    case when d = 0 then 0 else (n_convs - 1) * len(list_filter(regexp_split_to_array(path[d].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) end as saved
  from node left join kid using (path, d)
),
up as (select path[1:k] as path, k as d, n_children, saved from (select *, unnest(range(d + 1)) as k from own_sum)),
total as (select path, d, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from up group by all)
select s.conv_id, s.d as depth, a.conv_id as parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
from own_sum s join total using (path, d) left join node a on s.d > 0 and a.d = s.d - 1 and a.path = s.path[1:s.d - 1]
"""


@query("op12_conversation_trie", TRIE_SQL)
def _(spark, folder):
    return trie.conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op13_toxicity")
def _(spark, folder):
    return toxicity.toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
