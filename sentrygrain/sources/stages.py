"""Stage tables: results written once and read by the stages behind them.

They live below the shared folder the cluster names in ``spark.checkpoint.dir``,
so a lost executor costs a re-read, never a recomputation from the start.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..contracts import ContractError

_LOCAL_ROOTS: dict[str, str] = {}
_SAVED: dict[tuple, object] = {}


def stage_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = context.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/stages-{context.applicationId}"


class Checks:
    """What a stage's own write counts about its rows, so that a guard costs no further scan.

    ``save`` refuses the stage if a count is not as it should be.
    """

    def __init__(self):
        self._bad: list[tuple[str, Observation]] = []
        self._rows: list[tuple[str, Observation, Observation]] = []

    def none(self, df: DataFrame, what: str, bad: dict[str, Column]) -> DataFrame:
        """``df``, of which no row may fulfil one of ``bad``."""
        seen = Observation()
        self._bad.append((what, seen))
        return df.observe(seen, *[F.count_if(c).alias(name) for name, c in bad.items()])

    def join(self, left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
        """Left join that must keep the number of rows: ``keys`` are unique on the right."""
        before, after = Observation(), Observation()
        self._rows.append((what, before, after))
        rows = left.observe(before, F.count(F.lit(1)).alias("n")).join(right, keys, "left")
        return rows.observe(after, F.count(F.lit(1)).alias("n"))

    def verify(self) -> None:
        for what, seen in self._bad:
            bad = {name: n for name, n in seen.get.items() if n}
            if bad:
                raise ContractError(f"{what}: {bad}")
        for what, before, after in self._rows:
            if before.get["n"] != after.get["n"]:
                raise ContractError(f"{what}: {before.get['n']} rows became {after.get['n']}, its keys are not unique")


def save(df: DataFrame, *, partition_by: list[str] | None = None, checks: Checks | None = None) -> DataFrame:
    """Write ``df`` as parquet and return it read back, with a short lineage."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if checks is not None:
        checks.verify()
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: tuple, build: Callable[[], object]):
    """The result of ``build`` for ``key``, built at most once per application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _SAVED:
        _SAVED[full] = build()
    return _SAVED[full]
