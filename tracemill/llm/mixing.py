"""Mixing sources to target shares of all tokens.

The texts of each source, in the order of a hash of their id, form one stream of
tokens that is cut into blocks of ``BLOCK`` tokens. A mix is made of shards of
``SLOTS`` blocks. Source counts per shard come from splitting the mix's counts
down a binary tree by multinomial draws held within what is left, so each shard finds
its own counts alone and the sums are exact, at every size alike. The k-th slot of a source goes to block
``perm(k mod n)`` of pass ``k div n``, by a keyed permutation of the source's n
blocks, and blocks are joined by their number: no source is sorted or sampled,
and no block comes more often than there are passes.

A source gets its share of ``total`` tokens (by default all tokens of the mix's
sources) unless ``max_repeats`` passes give less; then the others share the rest
in their proportions, within their own limits. The shares reached are reported.

Defined results: null texts, texts without tokens and sources that no mix names
take no part; spellings of a source differ by case, spaces, ``-`` and ``_`` alone
are one source; rows of one source in one mix are one (shares added, the smallest
``max_repeats``); a share or ``max_repeats`` that is null, NaN or below 0 is 0; a
source without documents reaches share 0.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import cut

BLOCK = 512
SLOTS = 64
SHARDS_A_TASK, SHARDS_AT_ONCE = 48, 64
BUCKET_ROWS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_BYTES = 16 << 20
MIX_ROWS = 100_000


def source_name(c: Column) -> Column:
    """One spelling of a source; blank goes to null."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_")), F.lit(""))


def count_tokens(df: DataFrame, key: str, col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, keep..., n_tokens) by a public tokenizer's file, which is sent to the executors (``TOKENIZER_BYTES`` at most)."""
    if os.path.getsize(tokenizer) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {TOKENIZER_BYTES} bytes")
    with open(tokenizer, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(sent.value)
        t.encode_special_tokens = True
        for pdf in it:
            n = []
            for a in range(0, len(pdf), 128):
                n += [len(e.ids) for e in t.encode_batch(pdf["_t"].iloc[a : a + 128].tolist(), add_special_tokens=False)]
            yield pdf.drop(columns="_t").assign(n_tokens=np.array(n, dtype="int64"))

    t = df.select(key, *keep, F.col(col).alias("_t")).where("_t IS NOT NULL AND _t <> ''")
    kinds = dict(t.dtypes)
    return t.mapInPandas(count, ", ".join(f"`{c}` {kinds[c]}" for c in [key, *keep]) + ", n_tokens bigint")


def segments(counted: DataFrame, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(source, block_no, doc_id, from_token, to_token): the parts of texts in each block; to_token is not included.

    Places in a source's stream are summed in two steps, over buckets and within them, so no source meets in one task.
    """
    n = counted.groupBy("source").agg(F.ceil(F.count("*") / F.lit(bucket_rows)).alias("_n"))
    c = counted.join(F.broadcast(n), "source").withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.col("_n"))).drop("_n")
    sums = c.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_s"))
    sums = sums.select("source", "_b", (F.sum("_s").over(W.partitionBy("source").orderBy("_b")) - F.col("_s")).alias("_base"))
    w = W.partitionBy("source", "_b").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    c = c.join(F.broadcast(sums), ["source", "_b"]).withColumn("_at", F.col("_base") + F.sum("n_tokens").over(w) - F.col("n_tokens"))
    c = c.where("n_tokens > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("n_tokens") - 1) / block))))
    start = F.col("block_no") * block
    return c.select("source", "block_no", "doc_id", F.greatest(F.lit(0), start - F.col("_at")).alias("from_token"), F.least("n_tokens", start + block - F.col("_at")).alias("to_token"))


def allot(shares: dict[str, float], caps: dict[str, int], total: int) -> dict[str, int]:
    """Tokens per source: shares of ``total``, those over their cap at the cap and the rest in proportion."""
    out = {s: 0.0 for s in shares}
    free, left = {s for s in shares if shares[s] > 0 and caps[s] > 0}, float(total)
    while free:
        w = sum(shares[s] for s in free)
        over = {s for s in free if left * shares[s] / w >= caps[s]}
        for s in over or free:
            out[s] = float(caps[s]) if over else left * shares[s] / w
        if not over:
            break
        left -= sum(caps[s] for s in over)
        free -= over
    return {s: int(v) for s, v in out.items()}


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` slots of sources with ``counts`` left: multinomial, held within what is left of each; what that takes goes where most is left."""
    total = int(counts.sum())
    lo, hi = np.maximum(0, n - (total - counts)), counts
    out = np.clip(rng.multinomial(n, counts / total), lo, hi)
    while (d := n - int(out.sum())) != 0:
        room = hi - out if d > 0 else out - lo
        i = int(np.argmax(room))
        out[i] += min(d, room[i]) if d > 0 else -min(-d, room[i])
    return out


def shard_counts(counts: np.ndarray, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of every source in ``shard``, found along its path down the tree."""
    lo, hi = 0, -(-int(counts.sum()) // slots)
    first, here = np.zeros_like(counts), counts.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(np.random.default_rng([seed, lo, hi]), here, (mid - lo) * slots)
        if shard < mid:
            here, hi = left, mid
        else:
            first, here, lo = first + left, here - left, mid
    return first, here


def permuted(i: np.ndarray, n: int, key: str) -> np.ndarray:
    """A keyed permutation of 0..n-1 at ``i``: a four-round Feistel network, walked until it falls below ``n``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}/{r}")) for r in range(4)]
    out, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = a << np.uint64(half) | b
        todo &= out >= n
    return out.astype(np.int64)


def plan(targets: DataFrame, totals: DataFrame, total: int | None = None, block: int = BLOCK) -> dict[str, list[tuple[str, int, int]]]:
    """mix -> [(source, its blocks, its slots)]; ``targets`` hold ``MIX_ROWS`` rows at the most."""
    t = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("p"), F.col("max_repeats").cast("long").alias("m"))
    t = t.where("mix_name IS NOT NULL AND source IS NOT NULL").select("mix_name", "source", F.expr("if(p > 0 AND NOT isnan(p), p, 0D)").alias("p"), F.expr("if(m > 0, m, 0L)").alias("m"))
    rows = t.groupBy("mix_name", "source").agg(F.sum("p").alias("p"), F.min("m").alias("m")).join(totals, "source", "left").limit(MIX_ROWS + 1).collect()
    if len(rows) > MIX_ROWS:
        raise ValueError(f"more than {MIX_ROWS} rows of targets")
    out: dict[str, list[tuple[str, int, int]]] = {}
    for mix in sorted({r.mix_name for r in rows}):
        own = sorted((r for r in rows if r.mix_name == mix), key=lambda r: r.source)
        have = {r.source: r.tokens or 0 for r in own}
        tokens = allot({r.source: r.p for r in own}, {r.source: r.m * have[r.source] for r in own}, sum(have.values()) if total is None else total)
        parts = []
        for r in own:
            n = -(-have[r.source] // block)
            if n:
                mean = have[r.source] / n  # the last block may be short
                parts.append((r.source, n, min(r.m * n, round(tokens[r.source] / mean))))
        if sum(k for _, _, k in parts):
            out[mix] = parts
    return out


def slots(spark, mixes: dict[str, list[tuple[str, int, int]]], seed: int = 0, per_shard: int = SLOTS) -> DataFrame:
    """(mix_name, shard, slot, source, block_no, repeat_no) of every slot; each shard is drawn on its own."""
    sent, ids = spark.sparkContext.broadcast(list(mixes.items())), None
    for i, parts in enumerate(mixes.values()):
        r = spark.range(-(-sum(k for _, _, k in parts) // per_shard)).select(F.lit(i).alias("mix"), F.col("id").alias("shard"))
        ids = r if ids is None else ids.union(r)

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), SHARDS_AT_ONCE):
                parts: dict[str, list] = {c: [] for c in ("mix", "shard", "slot", "source", "block_no", "repeat_no")}
                for mix, shard in zip(pdf["mix"].iloc[a : a + SHARDS_AT_ONCE], pdf["shard"].iloc[a : a + SHARDS_AT_ONCE]):
                    name, sources = sent.value[mix]
                    key = xxhash.xxh64_intdigest(f"{seed}/{name}")
                    first, here = shard_counts(np.array([k for _, _, k in sources], dtype=np.int64), int(shard), per_shard, key)
                    for i, (source, n, _) in enumerate(sources):
                        k = np.arange(first[i], first[i] + here[i])
                        for p in np.unique(k // n):
                            j = k[k // n == p] % n
                            parts["block_no"].append(permuted(j, n, f"{seed}/{name}/{source}/{p}"))
                            parts["repeat_no"].append(np.full(len(j), p))
                            parts["source"].append(np.full(len(j), i))
                    size = int(here.sum())
                    parts["slot"].append(np.random.default_rng([key, int(shard), 1]).permutation(size))
                    parts["mix"].append(np.full(size, mix))
                    parts["shard"].append(np.full(size, shard))
                if not parts["mix"]:
                    continue
                out = {c: np.concatenate(v) for c, v in parts.items()}
                yield pd.DataFrame({
                    "mix_name": [sent.value[m][0] for m in out["mix"]], "shard": out["shard"], "slot": out["slot"],
                    "source": [sent.value[m][1][i][0] for m, i in zip(out["mix"], out["source"])], "block_no": out["block_no"], "repeat_no": out["repeat_no"],
                })

    schema = "mix_name string, shard bigint, slot bigint, source string, block_no bigint, repeat_no bigint"
    if ids is None:
        return spark.createDataFrame([], schema)
    # a row of ids stands for a shard's work, which its bytes don't show: the number of tasks is set here
    shards = sum(-(-sum(k for _, _, k in parts) // per_shard) for parts in mixes.values())
    return ids.repartition(max(1, -(-shards // SHARDS_A_TASK)), "mix", "shard").mapInPandas(draw, schema)


def mix_sources(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, block: int = BLOCK, tokenizer: str = TOKENIZER) -> DataFrame:
    """(mix_name, shard, slot, source, repeat_no, block_no, doc_id, from_token, to_token): each mix as parts of texts in order of shard and slot."""
    spark = docs.sparkSession
    named = targets.select(source_name(F.col("source")).alias("source")).where("source IS NOT NULL").distinct()
    d = docs.select("doc_id", "text", source_name(F.col("source")).alias("source")).join(named, "source", "left_semi")
    counted = cut(count_tokens(d, "doc_id", "text", ["source"], tokenizer), "counted")
    mixes = plan(targets, counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), total, block)
    # a row of ids makes a shard's slots and a text its blocks, so either side looks small enough to broadcast when it is not
    return slots(spark, mixes, seed).hint("merge").join(segments(counted, block), ["source", "block_no"]).select("mix_name", "shard", "slot", "source", "repeat_no", "block_no", "doc_id", "from_token", "to_token")


def shares_reached(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, reached_share, tokens, most_repeats) of every source a mix names."""
    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    t = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("p")).where("mix_name IS NOT NULL AND source IS NOT NULL")
    t = t.groupBy("mix_name", "source").agg(F.sum(F.expr("if(p > 0 AND NOT isnan(p), p, 0D)")).alias("target_share"))
    out = t.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "most_repeats"])
    all_ = F.sum("tokens").over(W.partitionBy("mix_name"))
    return out.select("mix_name", "source", "target_share", F.when(all_ > 0, F.col("tokens") / all_).otherwise(0.0).alias("reached_share"), "tokens", "most_repeats")
