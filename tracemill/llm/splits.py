"""Splits that keep related records together.

Records hang together through the entities they hold. Components come from
alternating large-star and small-star steps over (entity, entity) edges: every
step is a grouped minimum and a join, no neighbourhood is ever collected, and
the edges are written to the shared folder after each round.

Defined results: records without any entity are left out; nulls and blanks are
no entities; repeated records and entities change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import bare_task, file_name, task_of_file
from tracemill.session import cut, discard

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of every node go to the least of its neighbourhood."""
    both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node. Raises if it does not settle."""
    e = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        old, e = e, cut(_small_star(_large_star(e)), "edges")
        state, before = _state(e), state
        discard(old)
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def record_entities(verify: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_type, record_id, entity): entities are ``0`` + task and ``1`` + image file, so that tasks sort first."""
    v = verify.select(F.lit("verify").alias("record_type"), F.col("verify_id").alias("record_id"), F.concat(F.lit("0"), bare_task(F.col("task_id"))).alias("entity"))
    f = samples.select(F.lit("sample").alias("record_type"), F.col("sample_id").alias("record_id"), F.explode("images").alias("_p")).withColumn("_f", file_name(F.col("_p")))
    s = f.select("record_type", "record_id", F.explode(F.array(F.concat(F.lit("1"), "_f"), F.concat(F.lit("0"), task_of_file(F.col("_f"))))).alias("entity"))
    return v.union(s).where("entity IS NOT NULL").distinct()


def related_groups(entities: DataFrame) -> DataFrame:
    """(record_type, record_id, group_task_id) of (record_type, record_id, entity); null when no task is in the group."""
    record = ["record_type", "record_id"]
    ent = cut(entities, "entities")
    least = cut(ent.groupBy(*record).agg(F.min("entity").alias("b")), "least")
    edges = ent.join(least, record).select(F.col("entity").alias("a"), "b")
    comp = components(edges)
    out = least.join(comp, least.b == comp.node, "left").select(*record, F.coalesce("component", "b").alias("_c"))
    return out.select(*record, F.when(F.col("_c").startswith("0"), F.expr("substring(_c, 2)")).alias("group_task_id"), F.col("_c").alias("group_id"))


def split_of(group: Column, shares: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 0) -> Column:
    """The split whose range holds the hash of ``group``; shares are in proportion to their sum."""
    total, at, out = sum(s for _, s in shares), 1.0, F.lit(shares[-1][0])
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), group)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    for name, share in reversed(shares[:-1]):
        at -= shares[[n for n, _ in shares].index(name) + 1][1] / total
        out = F.when(u < at, name).otherwise(out)
    return out
