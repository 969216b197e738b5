"""Vectors of screenshots: uniqueness among neighbours and farthest-point sampling, per pool.

Pools are split into blocks of ``BLOCK`` rows, so a hot pool is spread over tasks.
Distances are cosine distances in double precision; ties go to the smaller id.
Rows without a vector, with one that is empty, all zero or holds NaN, infinity or
null are left out; a pool's vectors have one length.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import cut, discard

BLOCK = 1024
NAMED = 64


def unit_vectors(df: DataFrame, pool: str, key: str, vector: str) -> DataFrame:
    """(_pool, _id, _x) with ``_x`` of length 1."""
    t = df.select(F.col(pool).alias("_pool"), F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    t = t.where(F.col("_id").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    t = t.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v))).where("_n > 0")
    return t.select("_pool", "_id", F.transform("_v", lambda v: v / F.col("_n")).alias("_x"))


def _blocked(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block, and (_pool, _blocks)."""
    n = rows.groupBy("_pool").agg(F.count("*").alias("_size"), F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    return rows.join(n, "_pool").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks"))), n


def neighbour_uniqueness(df: DataFrame, pool: str, key: str, vector: str, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(pool, key, uniqueness): mean distance to the ``k`` nearest others of the pool, all when there are fewer; 0 when alone.

    Exact. Each pair of blocks is one task's matrix product; only k distances a row leave it.
    """
    names = dict(df.dtypes)
    t, n = _blocked(cut(unit_vectors(df, pool, key, vector), "unit"), block)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    left = t.select("_pool", F.col("_block").alias("_i"), other.alias("_j"), "_id", "_x")
    fresh = [F.col(c).alias(c) for c in ("_pool", "_id", "_x")]  # attributes of their own beside those of ``left``
    right = t.select(*fresh, F.col("_block").alias("_j"), other.alias("_i"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_pool": [], "_id": [], "_d": []})
        x, y = np.stack(a["_x"].to_numpy()), np.stack(b["_x"].to_numpy())
        d = 1 - x @ y.T
        d[a["_id"].to_numpy()[:, None] == b["_id"].to_numpy()[None, :]] = np.inf
        m = min(k, d.shape[1])
        d = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
        return pd.DataFrame({"_pool": a["_pool"], "_id": a["_id"], "_d": [r[np.isfinite(r)] for r in d]})

    part = left.groupBy("_pool", "_i", "_j").cogroup(right.groupBy("_pool", "_i", "_j")).applyInPandas(nearest, f"_pool {names[pool]}, _id {names[key]}, _d array<double>")
    near = part.groupBy("_pool", "_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_d"))), 1, k).alias("_d"))
    mean = F.when(F.size("_d") > 0, F.aggregate("_d", F.lit(0.0), lambda a, v: a + v) / F.size("_d")).otherwise(0.0)
    return near.select(F.col("_pool").alias(pool), F.col("_id").alias(key), mean.alias("uniqueness"))


def _farthest(x: np.ndarray, picks: list[int], n: int) -> list[int]:
    """``picks`` and further ones, each the row farthest from those before; the first on ties."""
    least = (1 - x @ x[picks].T).min(1)
    least[picks] = -1
    while len(picks) < n:
        i = int(np.argmax(least))
        picks.append(i)
        least = np.minimum(least, 1 - x @ x[i])
        least[picks] = -1
    return picks


def _nearer(rows: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
    """A block's rows with their least distance to all picks (-1 for picks); the ``NAMED`` farthest are named, ``_edge`` is the distance from which on others may lie."""
    out = rows[["_pool", "_block", "_id", "_x", "_n", "_least"]].sort_values("_id", kind="stable").reset_index(drop=True)
    least = out["_least"].to_numpy(dtype=float).copy()
    if len(out) and len(picks):
        least = np.minimum(least, (1 - np.stack(out["_x"].to_numpy()) @ np.stack(picks["_x"].to_numpy()).T).min(1))
        least[out["_id"].isin(picks["_id"]).to_numpy()] = -1
    order = np.argsort(-least, kind="stable")
    named = np.zeros(len(out), bool)
    named[order[:NAMED]] = True
    return out.assign(_least=least, _edge=least[order[NAMED]] if len(out) > NAMED else -2.0, _named=named)


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The next picks of a pool from its blocks' named rows, as long as no other row can be farther."""
    pdf = pdf.sort_values("_id", kind="stable").reset_index(drop=True)
    x, least, edge = np.stack(pdf["_x"].to_numpy()), pdf["_least"].to_numpy(dtype=float).copy(), pdf["_edge"].max()
    have, n, picks = int(pdf["_have"].iloc[0]), int(pdf["_n"].iloc[0]), []
    while have + len(picks) < n:
        i = int(np.argmax(least))
        if picks and least[i] <= edge or least[i] < 0 and len(picks):
            break
        picks.append(i)
        least = np.minimum(least, 1 - x @ x[i])
        least[picks] = -1
    return pdf.iloc[picks][["_pool", "_id", "_x"]].assign(pick_no=np.arange(have + 1, have + 1 + len(picks)))


def farthest_points(df: DataFrame, seeds: DataFrame, wanted: DataFrame, pool: str, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(pool, key, pick_no): ``n`` picks of each pool, from its seed on (``seeds``: pool, key; ``wanted``: pool, n).

    A pool with no more than n rows gives all in order of key. Pools of one block are done in one
    task; in larger ones each round every block names its ``NAMED`` farthest rows, and picks are made among
    those until a row that was not named might be farther. So a round makes many picks, and they are exact.
    """
    names = dict(df.dtypes)
    rows = cut(unit_vectors(df, pool, key, vector), "unit")
    t, size = _blocked(rows, block)
    w = wanted.groupBy(F.col(pool).alias("_pool")).agg(F.max("n").alias("_n")).where("_n > 0")
    s = seeds.select(F.col(pool).alias("_pool"), F.col(key).alias("_seed"))
    t = cut(t.join(w, "_pool").join(s, "_pool"), "asked")
    schema = f"_pool {names[pool]}, _id {names[key]}, pick_no bigint"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable").reset_index(drop=True)
        n = int(pdf["_n"].iloc[0])
        at = np.flatnonzero(pdf["_id"].to_numpy() == pdf["_seed"].iloc[0])
        picks = list(range(len(pdf))) if n >= len(pdf) or not len(at) else _farthest(np.stack(pdf["_x"].to_numpy()), [int(at[0])], n)
        return pd.DataFrame({"_pool": pdf["_pool"].iloc[0], "_id": pdf["_id"].iloc[picks].to_numpy(), "pick_no": np.arange(1, len(picks) + 1)})[: n if len(at) or n < len(pdf) else None]

    small = t.where("_blocks = 1").groupBy("_pool").applyInPandas(whole, schema)
    all_ = t.where("_blocks > 1 AND _n >= _size").select("_pool", "_id", F.row_number().over(W.partitionBy("_pool").orderBy("_id")).cast("bigint").alias("pick_no"))
    large = t.where("_blocks > 1 AND _n < _size")
    picks = cut(large.where("_id = _seed").select("_pool", "_id", "_x", F.lit(1).cast("bigint").alias("pick_no")), "picks")
    state = large.select("_pool", "_block", "_id", "_x", "_n", F.lit(2.0).alias("_least"))
    parts, fresh = [picks], picks
    blocks = size.select("_pool", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))
    kinds = f"_pool {names[pool]}, _block bigint, _id {names[key]}, _x array<double>, _n bigint, _least double, _edge double, _named boolean"
    while not fresh.isEmpty():
        # every row keeps its least distance to the picks so far, so only the newest picks are sent; a block names its farthest rows
        sent = fresh.join(blocks, "_pool").select("_pool", "_block", "_id", "_x")
        told = cut(state.groupBy("_pool", "_block").cogroup(sent.groupBy("_pool", "_block")).applyInPandas(_nearer, kinds), "least")
        discard(state)
        state = told
        have = functools.reduce(DataFrame.union, parts).groupBy("_pool").agg(F.max("pick_no").alias("_have"))
        asked = told.where("_named").join(have, "_pool").where("_have < _n")
        fresh = cut(asked.groupBy("_pool").applyInPandas(_choose, f"_pool {names[pool]}, _id {names[key]}, _x array<double>, pick_no bigint"), "picks")
        parts.append(fresh)
    out = small.union(all_).union(functools.reduce(DataFrame.union, parts).select("_pool", "_id", "pick_no"))
    return out.select(F.col("_pool").alias(pool), F.col("_id").alias(key), "pick_no")


def diverse_samples(df: DataFrame, wanted: DataFrame, pool: str, key: str, vector: str, k: int = 20) -> DataFrame:
    """(pool, key, uniqueness, rank): farthest points from the most unique row on, ordered by uniqueness and then by pick."""
    u = cut(neighbour_uniqueness(df, pool, key, vector, k), "uniqueness")
    seeds = u.groupBy(pool).agg(F.min(F.struct((-F.round("uniqueness", 12)).alias("u"), F.col(key).alias("i"))).alias("_m")).select(pool, F.col("_m.i").alias(key))
    p = farthest_points(df, seeds, wanted, pool, key, vector).join(u, [pool, key])
    return p.withColumn("rank", F.row_number().over(W.partitionBy(pool).orderBy(F.desc(F.round("uniqueness", 12)), "pick_no")).cast("bigint")).select(pool, key, "uniqueness", "rank")


def valid_indices(selection: DataFrame, keys: list[str], indices: str, total: str) -> DataFrame:
    """(keys, pos, index): chosen indices in range, repeats kept once at their first place. Fewer or more than asked may be left."""
    t = selection.select(*keys, F.col(total).alias("_total"), F.posexplode(indices).alias("_at", "index")).where("index >= 0 AND index < _total")
    t = t.groupBy(*keys, "index").agg(F.min("_at").alias("_at"))
    return t.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("_at")).cast("bigint").alias("pos"), F.col("index").cast("bigint").alias("index"))


def chosen_paths(valid: DataFrame, images: DataFrame, keys: list[str], reasons: DataFrame | None = None) -> DataFrame:
    """(keys, pos, index, path, reason) of chosen indices (as from ``valid_indices``) over numbered images (keys, index, path).

    ``reasons`` (keys, at, index, reason): the last of an index holds; '' where there is none.
    """
    out = valid.join(images.select(*keys, "index", "path"), [*keys, "index"])
    if reasons is None:
        return out.select(*keys, "pos", "index", "path", F.lit("").alias("reason"))
    last = reasons.groupBy(*keys, "index").agg(F.max_by("reason", "at").alias("reason"))
    return out.join(last, [*keys, "index"], "left").select(*keys, "pos", "index", "path", F.coalesce("reason", F.lit("")).alias("reason"))
