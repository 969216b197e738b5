"""What is left to do, what may be reused, and checks that stop a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExpectationError(RuntimeError):
    """A check on the data failed."""


def unfinished(tasks: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished run; null keys are never finished."""
    return tasks.join(finished.select(*keys).distinct(), keys, "left_anti")


def finished_ids(finished: DataFrame, domain: str = "domain", key: str = "task_id", chunk: int = 10_000) -> DataFrame:
    """(domain, chunk, n, task_ids): finished ids of every domain, each once, in chunks by hash so that no list grows with the data."""
    t = finished.select(domain, key).where(F.col(key).isNotNull()).distinct()
    size = t.groupBy(domain).agg(F.ceil(F.count("*") / F.lit(chunk)).alias("_chunks"))
    t = t.join(size.withColumnRenamed(domain, "_d"), F.col(domain).eqNullSafe(F.col("_d"))).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("_chunks")))
    return t.groupBy(domain, "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("task_ids"))


def cache_split(tasks: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks with ``reused``: whether the cache holds them. Cached keys that are no task drop out."""
    c = cached.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return tasks.join(c, keys, "left").withColumn("reused", F.coalesce("_hit", F.lit(False))).drop("_hit")


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that are not present."""
    return wanted.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def expect_complete(wanted: DataFrame, present: DataFrame, keys: list[str], show: int = 20) -> None:
    """Raises with up to ``show`` of the missing keys."""
    m = missing(wanted, present, keys).orderBy(*keys).limit(show).collect()
    if m:
        raise ExpectationError("missing: " + ", ".join("/".join(map(str, r)) for r in m))


def expect_equal_counts(a: DataFrame, b: DataFrame) -> None:
    if (x := a.count()) != (y := b.count()):
        raise ExpectationError(f"{x} and {y} records")
