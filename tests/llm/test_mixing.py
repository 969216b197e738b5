"""Mixes against their targets and limits."""

from collections import Counter

import numpy as np
import pytest

from tracemill.llm.mixing import TOKENIZER, allot, count_tokens, mix_sources, permuted, segments, shard_counts, shares_reached


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(permuted(np.arange(n), n, "k")) == list(range(n))
    assert list(permuted(np.arange(1000), 1000, "a")) != list(permuted(np.arange(1000), 1000, "b"))


def test_shards_sum_to_the_counts():
    counts = np.array([0, 1, 130, 999, 6400])
    n = -(-int(counts.sum()) // 64)
    at = np.zeros_like(counts)
    for s in range(n):
        first, here = shard_counts(counts, s, 64, 5)
        assert list(first) == list(at) and (here.sum() == 64 or s == n - 1)
        at = at + here
    assert list(at) == list(counts)
    large = np.array([3 * 10**9, 10**9, 5])
    first, here = shard_counts(large, 12345, 64, 5)
    assert here.sum() == 64 and (here >= 0).all() and (first >= 0).all()


def test_allotment():
    assert allot({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, 100) == {"a": 50, "b": 50}
    assert allot({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 100) == {"a": 10, "b": 90}
    assert allot({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 20, "c": 10}, 100) == {"a": 10, "b": 20, "c": 10}
    assert allot({"a": 0.9, "b": 0.1}, {"a": 0, "b": 100}, 50) == {"a": 0, "b": 50}


def test_segments_tile_every_stream(spark):
    rows = [(i, f"s{i % 3 == 0}", (i * 37) % 900) for i in range(500)]
    c = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    by = {}
    for r in segments(c, 100, bucket_rows=17).collect():
        by.setdefault(r.source, []).append(r)
    for source, parts in by.items():
        size = Counter()
        cover = {}
        for r in parts:
            assert 0 <= r.from_token < r.to_token
            size[r.block_no] += r.to_token - r.from_token
            cover.setdefault(r.doc_id, []).append((r.from_token, r.to_token))
        last = max(size)
        assert all(size[b] == 100 for b in range(last)) and 0 < size[last] <= 100
        for i, s, n in rows:
            if s == source and n:
                got = sorted(cover[i])
                assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_small_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, targets = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_target.parquet")
    mix = mix_sources(docs, targets, block=64).cache()
    again = mix_sources(docs, targets, block=64)
    assert mix.exceptAll(again).isEmpty() and again.exceptAll(mix).isEmpty()
    limit = {(r.mix_name, r.source): r.max_repeats for r in targets.collect()}
    most = mix.groupBy("mix_name", "source", "doc_id", "from_token").count().collect()
    assert all(r["count"] <= limit[r.mix_name, r.source] for r in most)
    shares = shares_reached(mix, targets).collect()
    assert len(shares) == 35
    full = {}
    for r in shares:
        assert r.most_repeats <= limit[r.mix_name, r.source]
        if 0 < r.most_repeats < limit[r.mix_name, r.source]:
            full.setdefault(r.mix_name, []).append(r.reached_share / r.target_share)
    for v in full.values():  # sources that are not held back keep their proportions
        assert max(v) / min(v) < 1.35
    slots = mix.select("mix_name", "shard", "slot").distinct().groupBy("mix_name", "shard").count().collect()
    assert max(r["count"] for r in slots) == 64


def test_slots_and_segments_are_never_broadcast(spark):
    """Both sides grow with the texts, whatever sizes are guessed from ids and counts; only rows per source and bucket go to all tasks."""
    d = "/root/testdata/sf0.001"
    mix = mix_sources(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_target.parquet"))
    plan = mix._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join [" in x and "block_no" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0], plan


def test_edges(spark):
    schema = "doc_id long, text string, source string, n_tokens int"
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "word " * 50000, " A ", 0), (4, "x y z", None, 0), (4, "x y z", "b-b", 0), (4, "x y z", "B b", 0)]
    t = "mix_name string, source string, target_share double, max_repeats long"
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b_b", 0.5, 2), ("m", "none", None, None), (None, "a", 1.0, 1), ("m", None, 1.0, 1)], t)
    docs = spark.createDataFrame(rows, schema)
    got = {r.source: (r.tokens, r.most_repeats) for r in shares_reached(mix_sources(docs, targets), targets).collect()}
    assert got["none"] == (0, 0) and got["a"][1] == 1 and got["b_b"][1] == 2
    assert shares_reached(mix_sources(docs.limit(0), targets), targets).count() == 3
    assert mix_sources(docs, targets.limit(0)).count() == 0
    n = count_tokens(docs, "doc_id", "text", [], TOKENIZER)
    assert n.where("n_tokens > 50000").count() == 1
