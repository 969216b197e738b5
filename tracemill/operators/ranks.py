"""Numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import cut


def number_rows(df: DataFrame, order: list[str], out: str = "n", start: int = 1) -> DataFrame:
    """``df`` with ``out``: start, start + 1, ... by ``order`` (nulls first). Ties are numbered in any order.

    Rows are range-partitioned once; a partition's numbers begin after the counts of those before it.
    """
    p = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    c = p.groupBy("_part").agg(F.count("*").alias("_c"))
    base = c.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_base"))  # a row per partition
    n = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_base") + F.lit(start - 1)
    return p.join(base, "_part").withColumn(out, n.cast("bigint")).drop("_part", "_base")


def balanced_shards(df: DataFrame, order: list[str], shards: int, out: str = "shard") -> DataFrame:
    """Contiguous shards 1..``shards``; the first of them get one row more when it does not come out even."""
    n, total = number_rows(df, order, "_n", 0), df.count()
    size, more = divmod(total, shards)
    cut_at = (size + 1) * more
    shard = F.when(F.col("_n") < cut_at, F.floor(F.col("_n") / (size + 1))).otherwise(more + F.floor((F.col("_n") - cut_at) / max(size, 1)))
    return n.withColumn(out, (shard + 1).cast("bigint")).drop("_n")
