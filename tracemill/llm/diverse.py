"""A varied subset of vectors per pool, by tournament-pivoted rank-revealing QR.

Rows of a pool are dealt to blocks. Each block nominates linearly independent
rows by QR with column pivoting (the row with the largest part outside the span
of those picked before comes next), and pairs of blocks re-pivot their nominees
until one block is left. When the rank is used up, rows near a pick are struck
out (deflation) and a further round begins with an empty span, inside a block
and across the whole pool, until every row is near a pick or k are picked. A pool
that is to give more than that goes on with deflated rounds over the struck-out
rows not picked yet, until it has k or no row is left.

At most ``BLOCK`` rows and ``NOMINEES`` nominees meet in a task; a pool with
more different rows than that takes further rounds over the rows left. Hot pools
are spread over as many blocks as their rows need.

Defined results: vectors that are null, empty, all zero, of another length than
most of the pool's, or hold NaN, infinity or null are unreadable and are left
out; length does not count; equal rows are picked once, by the smallest id.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import cut

NEAR = 0.08
BLOCK = 1024
NOMINEES = 2048
INDEPENDENT = 1e-6


def pivot(x: np.ndarray, near: float, most: int, again: bool = False) -> list[int]:
    """Positions picked from unit rows ``x``, in order of picking.

    Ties go to the first row. Rows within cosine distance ``near`` of a pick are struck out; with
    ``again``, those not picked come back once none is left.
    """
    left = np.ones(len(x), bool)
    picks: list[int] = []
    while len(picks) < most:
        if again and not left.any():
            left = np.ones(len(x), bool)
            left[picks] = False
        if not left.any():
            break
        rest = np.where(left, 1.0, -1.0)  # squared part outside the span
        span = np.empty((0, x.shape[1]))
        while len(picks) < most:
            i = int(np.argmax(rest))
            if rest[i] <= INDEPENDENT:
                break
            picks.append(i)
            left &= x @ x[i] <= 1 - near
            left[i] = False
            q = x[i] - span.T @ (span @ x[i])
            q -= span.T @ (span @ q)
            q /= np.linalg.norm(q)
            span = np.vstack([span, q])
            rest = np.where(left, rest - (x @ q) ** 2, -1.0)
    return picks


def _nominate(near: float, most: int, again: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable").reset_index(drop=True)
        x = np.stack(pdf["_x"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        p = pivot(x, near, min(most, pdf["_most"].iloc[0]) if again else most, again)
        return pdf.iloc[p].assign(_rank=np.arange(len(p), dtype="int32"))[["_pool", "_block", "_id", "_x", "_rank", *["_most"] * again]]

    return run


def _tournament(rows: DataFrame, near: float, block: int, nominees: int, again: bool = False) -> DataFrame:
    """(_pool, _id, _x, _rank): the nominees of every pool after pairwise reductions of its blocks; with ``again``, ``_most`` of them and struck-out rows too."""
    size = rows.groupBy("_pool").agg(F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    dealt = rows.join(size, "_pool").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    more = ["_most"] if again else []
    schema = f"_pool {kinds['_pool']}, _block int, _id {kinds['_id']}, _x array<double>, _rank int" + ", _most long" * again
    won = cut(dealt.select("_pool", "_block", "_id", "_x", *more).groupBy("_pool", "_block").applyInPandas(_nominate(near, nominees, again), schema), "nominees")
    most = size.agg(F.max("_blocks")).first()[0] or 1
    while most > 1:
        won = cut(won.select("_pool", F.floor(F.col("_block") / 2).cast("int").alias("_block"), "_id", "_x", *more).groupBy("_pool", "_block").applyInPandas(_nominate(near, nominees, again), schema), "nominees")
        most = -(-most // 2)
    return won.drop("_block", "_most")


def readable(df: DataFrame, pool: str, key: str, vector: str) -> DataFrame:
    """(_pool, _id, _x): readable vectors of unit length, each id once."""
    t = df.select(F.col(pool).alias("_pool"), F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where("_id IS NOT NULL AND size(_v) > 0")
    t = t.where(~F.exists("_v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
    t = t.withColumn("_max", F.array_max(F.transform("_v", lambda v: F.abs(v)))).where("_max > 0")
    t = t.withColumn("_v", F.transform("_v", lambda v: v / F.col("_max")))
    t = t.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v))).select("_pool", "_id", F.transform("_v", lambda v: v / F.col("_n")).alias("_x"))
    t = t.groupBy("_pool", "_id").agg(F.min("_x").alias("_x"))
    width = t.groupBy("_pool", F.size("_x").alias("_w")).count().groupBy("_pool").agg(F.max_by("_w", F.struct("count", "_w")).alias("_w"))
    return t.join(width, "_pool").where(F.size("_x") == F.col("_w")).drop("_w")


def _cover(near: float):
    """Which pick each row is near to; rows of one block meet the picks of their pool."""

    def run(key: tuple, rows: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(picks):
            return pd.DataFrame({"_pool": rows["_pool"], "_id": rows["_id"], "_x": rows["_x"], "_pick": pd.Series([-1] * len(rows), dtype="int32")})
        picks = picks.sort_values("_rank")
        p, out = np.stack(picks["_x"].to_numpy()), []
        x = np.stack(rows["_x"].to_numpy())
        for a in range(0, len(x), 4096):
            d = x[a : a + 4096] @ p.T > 1 - near
            out.append(np.where(d.any(1), picks["_rank"].to_numpy()[d.argmax(1)], -1))
        return pd.DataFrame({"_pool": rows["_pool"], "_id": rows["_id"], "_x": rows["_x"], "_pick": np.concatenate(out).astype("int32")})

    return run


def _filled(rows: DataFrame, lack: DataFrame, near: float, block: int, nominees: int, done: int) -> list[DataFrame]:
    """Parts of (_pool, _id, n_near, _order) with ``_lack`` more picks of every pool of ``lack``, from ``rows`` that are no picks yet."""
    parts: list[DataFrame] = []
    rows, most = cut(rows.join(lack, "_pool"), "unpicked"), lack.agg(F.max("_lack")).first()[0] or 0
    for at in range(0, most, nominees):
        left = rows.withColumn("_most", F.col("_lack") - F.lit(at)).where("_most > 0")
        for x in parts:
            left = left.join(x, ["_pool", "_id"], "left_anti")
        parts.append(_tournament(left, near, block, nominees, True).select("_pool", "_id", F.lit(1).cast("long").alias("n_near"), (F.col("_rank") + F.lit(done + at)).alias("_order")))
    return parts


def varied_subset(df: DataFrame, pool: str = "pool_id", key: str = "image_id", vector: str = "embedding", near: float = NEAR, wanted: DataFrame | None = None, block: int = BLOCK, nominees: int = NOMINEES) -> DataFrame:
    """(pool, key, n_near, pick_no): picks of every pool, ``key`` the smallest id near the pick, and how many rows are near it.

    ``wanted`` (pool, k) gives a pool k picks, or all its readable rows if they are fewer: once every row is near a pick,
    rows near one are picked too, and such a pick stands for itself alone (``n_near`` 1). Without it a pool ends when every row is near a pick.
    """
    names = dict(df.dtypes)
    rows = every = cut(readable(df, pool, key, vector), "rows")
    parts, done = [], 0
    if wanted is not None:
        k = wanted.groupBy(F.col(pool).alias("_pool")).agg(F.max("k").cast("long").alias("_k"))
    while not rows.isEmpty():
        picks = _tournament(rows, near, block, nominees)
        n = rows.groupBy("_pool").agg(F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
        dealt = rows.join(n, "_pool").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
        # picks are at most ``nominees`` a pool and go to each of its blocks
        sent = picks.join(n, "_pool").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        schema = f"_pool {names[pool]}, _id {names[key]}, _x array<double>, _pick int"
        near_to = cut(dealt.select("_pool", "_block", "_id", "_x").groupBy("_pool", "_block").cogroup(sent.select("_pool", "_block", "_rank", "_x").groupBy("_pool", "_block")).applyInPandas(_cover(near), schema), "near")
        parts.append(near_to.where("_pick >= 0").groupBy("_pool", "_pick").agg(F.min("_id").alias("_id"), F.count("*").alias("n_near")).select("_pool", "_id", "n_near", (F.col("_pick") + F.lit(done)).alias("_order")))
        rows = near_to.where("_pick < 0").select("_pool", "_id", "_x")
        done += nominees
        if wanted is not None:
            # by picks made, not by numbers given: a round seldom uses all of its ``nominees``
            have = functools.reduce(DataFrame.union, parts).groupBy("_pool").agg(F.count("*").alias("_have"))
            rows = rows.join(have.join(k, "_pool").where("_k > _have").select("_pool"), "_pool", "left_semi")
    if not parts:
        return df.sparkSession.createDataFrame([], f"{pool} {names[pool]}, {key} {names[key]}, n_near long, pick_no int")
    out = functools.reduce(DataFrame.union, parts)
    if wanted is not None:
        out = cut(out, "picks")
        lack = cut(out.groupBy("_pool").count().join(k, "_pool").select("_pool", (F.col("_k") - F.col("count")).alias("_lack")).where("_lack > 0"), "lack")
        out = functools.reduce(DataFrame.union, _filled(every.join(out, ["_pool", "_id"], "left_anti"), lack, near, block, nominees, done), out)
    # numbers of a round have gaps where a pool has fewer picks
    out = out.withColumn("pick_no", F.row_number().over(W.partitionBy("_pool").orderBy("_order")))
    if wanted is not None:
        out = out.join(k, "_pool").where(F.col("pick_no") <= F.col("_k"))
    return out.select(F.col("_pool").alias(pool), F.col("_id").alias(key), "n_near", "pick_no")
