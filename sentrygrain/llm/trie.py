"""Prefix trie of conversations as balanced parentheses, built in shards.

A conversation becomes the string of its turns' 128-bit digests (role and text), 16
bytes a turn. Spark range-partitions and sorts these strings, then ids, so a task sees the trie in
preorder and cuts it into shards of bounded size. A shard writes its part of the trie as
balanced parentheses; a tree of block minima of the excess answers findclose, which
delimits every subtree. Rank of leaf pairs ``()`` gives leaves, cumulated ends give
members, cumulated savings the tokens that sharing saves.

Only nodes on a shard's first or last path can go on in another shard. Such a spine
node is sent on in parts, which Spark merges: counts add up, and what a spine node adds to the
nodes above it runs along the path of one shard (sums over a window of that path).
The ids of a spine node's ends travel as sorted pieces of text and are hashed in order.

Null role or text counts as empty, null turns come first, turns of one number are ordered
by digest, so repeated rows are turns of their own. Rows without conv_id are left out,
extra columns are ignored, and an empty table has no nodes. Long texts never leave the row they
are in. A conversation's digests are one row, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import save

#: A shard ends with the row that reaches one of these bounds.
SHARD_ROWS = 1 << 16
SHARD_TURNS = 1 << 19
#: Ids in one piece of text of a spine node's ends.
PIECE = 512
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A node, a part of a spine node (``side`` is 1 on the first path, 2 on the last, 3 on both), or a piece of its ends' ids.
ROWS = f"kind string, shard long, side int, key binary, parent_key binary, words long, piece long, ids string, {NODE}"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): digests of the turns in order, and their numbers of words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        "conv_id",
        F.struct(
            "turn",
            F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
            F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("t"),
    )
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return rows.select("conv_id", F.unhex(F.array_join("ts.digest", "")).alias("path"), F.col("ts.words").alias("words"))


def rebuilt(rows: DataFrame, *, family: int = 20, most: int = 3) -> DataFrame:
    """Sequences whose first h turns come from the conversation with the family's number; h is crc32 of the id modulo ``most`` + 1."""
    h = "cast(crc32(cast(conv_id as string)) % {} as int)".format(most + 1)
    own = rows.withColumns({"base": F.expr(f"conv_id - conv_id % {family}"), "h": F.expr(h)})
    head = F.when(F.col("conv_id") == F.col("base"), F.struct(F.expr(f"substring(path, 1, {16 * most})").alias("path"), F.slice("words", 1, most).alias("words")))
    own = own.withColumn("head", F.first(head, ignorenulls=True).over(Window.partitionBy("base")))
    return own.select(
        "conv_id",
        F.expr("concat(coalesce(substring(head.path, 1, 16 * h), X''), substring(path, 16 * h + 1))").alias("path"),
        F.expr("concat(coalesce(slice(head.words, 1, h), array()), slice(words, h + 1, greatest(size(words), 1)))").alias("words"),
    )


class Parentheses:
    """Balanced parentheses with a tree of minima over blocks of the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // BLOCK)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        far = np.iinfo(np.int64).max
        self.padded = np.full(blocks * BLOCK, far)
        self.padded[: len(bits)] = self.excess
        self.low = np.full(2 * self.leaves, far)
        self.low[self.leaves : self.leaves + blocks] = self.padded.reshape(-1, BLOCK).min(axis=1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            nodes = slice(1 << level, 2 << level)
            self.low[nodes] = self.low[2 << level : 4 << level].reshape(-1, 2).min(axis=1)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at ``opens`` are closed."""
        target = self.excess[opens] - 1
        out = np.full(len(opens), -1)
        todo = np.arange(len(opens))
        for step in range(1, BLOCK):
            at = opens[todo] + step
            inside = at // BLOCK == opens[todo] // BLOCK
            hit = inside & (self.padded[at * inside] <= target[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (at % BLOCK != 0)]
            if not len(todo):
                break
        todo = np.flatnonzero(out < 0)
        out[todo] = self._beyond(opens[todo] // BLOCK + self.leaves, target[todo])
        return out

    def _beyond(self, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position in a block after each tree leaf ``node`` whose excess is at most ``target``."""
        node = node.copy()
        climbing = np.arange(len(node))
        while len(climbing):
            here = node[climbing]
            found = (here % 2 == 0) & (self.low[np.minimum(here + 1, len(self.low) - 1)] <= target[climbing])
            node[climbing] = np.where(found, here + 1, here // 2)
            climbing = climbing[~found]
        while (node < self.leaves).any():
            inner = node < self.leaves
            left = 2 * node[inner]
            node[inner] = np.where(self.low[left] <= target[inner], left, left + 1)
        out = np.empty(len(node), np.int64)
        for first in range(0, len(node), 1 << 14):
            some = slice(first, first + (1 << 14))
            block = node[some] - self.leaves
            rows = self.padded.reshape(-1, BLOCK)[block] <= target[some, None]
            out[some] = block * BLOCK + rows.argmax(axis=1)
        return out


class _Least:
    """Least value of any range, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.int64)
        level = np.frexp((ends - starts).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][starts[at]], self.table[k][ends[at] - (1 << int(k))])
        return out


def shared_turns(digests: np.ndarray, starts: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Turns that each row has in common with the row before it; 0 for the first."""
    out = np.zeros(len(depth), np.int64)
    todo, d = np.arange(1, len(depth)), 0
    while len(todo):
        if len(todo) < 16:
            for i in todo.tolist():
                n = min(depth[i], depth[i - 1])
                differ = (digests[starts[i] + d : starts[i] + n] != digests[starts[i - 1] + d : starts[i - 1] + n]).any(axis=1)
                out[i] = d + (int(differ.argmax()) if differ.any() else n - d)
            break
        todo = todo[np.minimum(depth[todo], depth[todo - 1]) > d]
        todo = todo[(digests[starts[todo] + d] == digests[starts[todo - 1] + d]).all(axis=1)]
        d += 1
        out[todo] = d
    return out


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shard_rows(shard: int, ids: np.ndarray, paths: list[bytes], words: np.ndarray) -> dict[str, list]:
    """Rows (``ROWS``) of one shard; ``paths`` are sorted, equal ones by id, ``words`` of all their turns in order."""
    depth = np.array([len(p) // 16 for p in paths], np.int64)
    starts = np.cumsum(depth) - depth
    flat = b"".join(paths)
    digests = np.frombuffer(flat, "<u8").reshape(-1, 2)
    common = shared_turns(digests, starts, depth)
    opened = depth - common
    closed = np.zeros(len(depth), np.int64)
    closed[1:] = depth[:-1] - common[1:]
    runs = np.column_stack([closed, opened]).ravel()
    bits = np.repeat(np.tile(np.array([0, 1], np.int8), len(depth)), runs)
    bits = np.concatenate([[1], bits, np.zeros(depth[-1] + 1, np.int8)]).astype(np.int8)

    tree = Parentheses(bits)
    opens = np.flatnonzero(bits)
    closes = tree.findclose(opens)
    n = len(opens)
    after = np.arange(n) + (closes - opens + 1) // 2  # first node behind each subtree
    level = tree.excess[opens] - 1
    by_level = np.sort(level * n + np.arange(n))
    parent = by_level[np.searchsorted(by_level, (level - 1) * n + np.arange(n)) - 1] % n
    parent[0] = 0
    row = np.concatenate([[0], np.repeat(np.arange(len(depth)), opened)])
    cost = np.zeros(n, np.int64)
    cost[1:] = words[starts[row[1:]] + level[1:] - 1]

    ended = np.bincount(np.cumsum(opened), minlength=n)
    ends = np.concatenate([[0], np.cumsum(ended)])
    members = ends[after] - ends[:-1]
    least = _Least(ids).of(ends[:-1], ends[after])

    side = np.zeros(n, np.int32)
    side[: depth[0] + 1] = 1
    last = by_level[np.searchsorted(by_level, np.arange(1, depth[-1] + 2) * n) - 1] % n
    side[last] |= 2
    inner = side == 0
    children = np.bincount(parent[1:][inner[1:]], minlength=n)
    pair = np.zeros(len(bits) + 1, np.int64)
    pair[opens + 1] = inner & (bits[opens + 1] == 0)
    rank = np.cumsum(pair)
    leaves = rank[closes] - rank[opens]
    saved = np.concatenate([[0], np.cumsum(np.where(inner, (members - 1) * cost, 0))])
    savings = saved[after] - saved[:-1]

    keys: dict[int, bytes] = {}
    for chain, path in ((np.arange(depth[0] + 1), paths[0]), (last, paths[-1])):
        running = hashlib.md5()
        for d, node in enumerate(chain.tolist()):
            if d:
                running.update(path[16 * d - 16 : 16 * d])
            keys[node] = running.digest()

    out: dict[str, list] = {name.split()[0]: [] for name in ROWS.split(", ")}

    def put(kind, **values):
        for name, column in out.items():
            column.append(kind if name == "kind" else values.get(name))

    for k in range(n):
        up = int(parent[k])
        node = {"depth": int(level[k]), "conv_id": int(least[k]), "n_convs": int(members[k])}
        node |= {"n_children": int(children[k]), "n_leaves": int(leaves[k]), "saved_tokens": int(savings[k])}
        mine = ids[ends[k] : ends[k + 1]]
        if inner[k]:
            above = {"parent_key": keys[up]} if up in keys else {"parent_conv_id": int(least[up])}
            put("node", ends_sha256=hashlib.sha256(_joined(mine).encode()).hexdigest(), **above, **node)
            continue
        above = {"parent_key": keys[up]} if k else {}
        put("spine", shard=shard, side=int(side[k]), key=keys[k], words=int(cost[k]), **above, **node)
        for at in range(0, len(mine), PIECE):
            put("ends", shard=shard, key=keys[k], piece=at, ids=_joined(mine[at : at + PIECE]))
    return out


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ROWS.split(", "))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) in order -> (key, SHA-256 of each key's pieces, joined)."""
    names, key, running = ["key", "ends_sha256"], None, None
    for batch in batches:
        keys, found = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                running.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    found.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=names)


def _merged(rows: DataFrame) -> DataFrame:
    """Spine nodes whole: (key, parent_key) and the columns of ``NODE`` but parent_conv_id."""
    parts = rows.filter("kind = 'spine'")
    whole = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"),
        F.min("shard").alias("home"),
        F.min("words").alias("words"),
    )
    whole = save(whole)
    below = whole.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("spine_children"))
    whole = whole.join(below, "key", "left")
    whole = whole.withColumn("n_children", F.col("inner_children") + F.coalesce("spine_children", F.lit(0)))
    whole = save(whole.drop("inner_children", "spine_children"))
    # what a spine node adds itself counts once, on a path of the first shard that has it
    own = whole.select("key", "home", F.expr("if(n_children = 0, 1, 0)").alias("leaf"), F.expr("(n_convs - 1) * words").alias("saved"))
    paths = parts.join(own, "key").select("key", "shard", "home", "side", "depth", "leaf", "saved", F.explode(F.array(F.lit(1), F.lit(2))).alias("path"))
    paths = paths.filter(F.col("side").bitwiseAND(F.col("path")) != 0)
    counts = (F.col("shard") == F.col("home")) & ((F.col("path") == 2) | (F.col("side") == 1))
    along = Window.partitionBy("shard", "path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.sum(F.when(counts, F.col(c)).otherwise(0)).over(along) for c in ("leaf", "saved")}
    paths = paths.select("key", *[s.alias(c) for c, s in sums.items()])
    within = parts.select("key", F.col("n_leaves").alias("leaf"), F.col("saved_tokens").alias("saved"))
    totals = paths.union(within).groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    pieces = rows.filter("kind = 'ends'").select("key", "ids", "shard", "piece").repartition("key").sortWithinPartitions("key", "shard", "piece")
    ends = pieces.select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return save(whole.join(totals, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)))


def trie(rows: DataFrame, shard_rows_most: int = SHARD_ROWS, shard_turns_most: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, path, words) with distinct ids; a node is named by (conv_id, depth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        first = TaskContext.get().partitionId() << 32
        count, held, turns = 0, [], 0

        def done():
            ids = np.array([r[0] for r in held], np.int64)
            words = np.concatenate([np.asarray(r[2], np.int64) for r in held])
            return pa.RecordBatch.from_pydict(shard_rows(first + count, ids, [r[1] for r in held], words), schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                turns += len(row[2])
                if len(held) >= shard_rows_most or turns >= shard_turns_most:
                    yield done()
                    count, held, turns = count + 1, [], 0
        if held:
            yield done()

    dealt = save(rows.select("conv_id", "path", "words")).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    shards = save(dealt.mapInArrow(run, ROWS))
    spine = _merged(shards)
    names = [c.split()[0] for c in NODE.split(", ")]
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    inner = shards.filter("kind = 'node'")
    known = inner.filter("parent_key is null").select(names)
    open_ = inner.filter("parent_key is not null").select("parent_key", *[c for c in names if c != "parent_conv_id"])
    open_ = open_.unionByName(spine.select(open_.columns))
    found = open_.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    return known.unionByName(found.select(names))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(sequences(conversations)))
