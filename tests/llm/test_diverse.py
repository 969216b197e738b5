"""Varied subsets against plain searches."""

import numpy as np

from tracemill.llm.diverse import pivot, varied_subset

SCHEMA = "pool_id long, image_id long, embedding array<float>, n_near int"


def screens(rng, n, each, width=64):
    """Rows around ``n`` directions that are far from each other."""
    base = np.linalg.qr(rng.normal(size=(width, width)))[0] if n <= width else rng.normal(size=(n, width))
    out = []
    for i in range(n):
        for _ in range(each(i)):
            v = base[i] / np.linalg.norm(base[i]) + rng.normal(size=width) * 0.005
            out.append((i, (v * rng.uniform(0.2, 9)).tolist()))
    return out


def test_pivot_strikes_out_near_rows_and_goes_past_the_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = pivot(x, 0.08, 1000)
    d = 1 - x @ x[p].T
    assert (d.min(1) < 0.08).all() and len(p) > 8
    between = d[p]
    np.fill_diagonal(between, 9)
    assert between.min() >= 0.08 - 1e-12
    assert pivot(x, 0.08, 5) == p[:5]


def test_large_pool_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = screens(rng, 150, lambda i: 40 if i == 3 else 2)
    rng.shuffle(rows)
    data = [(1, k, v, 0) for k, (_, v) in enumerate(rows)] + [(2, 9, [1.0] * 64, 0)]
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(i, k)
    df = spark.createDataFrame(data, SCHEMA)
    want = {(1, k) for k in least.values()} | {(2, 9)}
    for block, nominees in ((1024, 512), (50, 512), (64, 40)):
        got = varied_subset(df, block=block, nominees=nominees).collect()
        assert {(r.pool_id, r.image_id) for r in got} == want
        assert sum(r.n_near for r in got) == len(data)
    k = spark.createDataFrame([(1, 30)], "pool_id long, k long")
    top = varied_subset(df, wanted=k, block=64, nominees=40).collect()
    assert sorted(r.pick_no for r in top) == list(range(1, 31)) and {(r.pool_id, r.image_id) for r in top} <= want


def test_small_table_against_plain_search(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/image_vector.parquet")
    by, want = {}, set()
    for r in t.orderBy("image_id").collect():
        e = np.array(r.embedding or [], dtype=float)
        if len(e) and np.isfinite(e).all() and np.linalg.norm(e):
            e /= np.linalg.norm(e)
            if all(1 - e @ x >= 0.08 for x in by.setdefault(r.pool_id, [])):
                want.add((r.pool_id, r.image_id))
                by[r.pool_id].append(e)
    assert {(r.pool_id, r.image_id) for r in varied_subset(t).collect()} == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 1, None, 0), (1, 2, [], 0), (1, 3, [0.0, 0.0], 0), (1, 4, [nan, 1.0], 0), (1, 5, [inf, 1.0], 0), (1, 6, [None, 1.0], 0), (1, None, [1.0, 0.0], 0), (1, 8, [1.0, 0.0], 0), (1, 8, [1.0, 0.0], 0), (1, 7, [9.0, 0.0], 0), (1, 9, [0.0, 2.0], 0), (1, 10, [1.0], 0), (None, 1, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.pool_id, r.image_id, r.n_near) for r in varied_subset(df).collect()}
    assert {x for x in got if x[0] == 1} == {(1, 7, 2), (1, 9, 1)}
    assert varied_subset(df.limit(0)).count() == 0


def test_wanted_goes_past_the_screens(spark):
    rng = np.random.default_rng(2)
    sizes = {1: [12, 1, 6, 3], 2: [40, 20], 3: [2, 1]}
    rows = [(pool, i, v) for pool, each in sizes.items() for i, v in screens(rng, len(each), each.__getitem__)]
    rng.shuffle(rows)
    screen = {k: (p, i) for k, (p, i, _) in enumerate(rows)}
    df = spark.createDataFrame([(int(p), k, v, 0) for k, (p, _, v) in enumerate(rows)], SCHEMA)
    wanted = spark.createDataFrame([(1, 20), (2, 30), (3, 20)], "pool_id long, k long")
    for block, nominees in ((1024, 512), (8, 6)):
        got = varied_subset(df, wanted=wanted, block=block, nominees=nominees).orderBy("pool_id", "pick_no").collect()
        for pool, n in ((1, 20), (2, 30), (3, 3)):
            mine = [r for r in got if r.pool_id == pool]
            assert [r.pick_no for r in mine] == list(range(1, n + 1)) and len({r.image_id for r in mine}) == n
            assert len({screen[r.image_id] for r in mine[: len(sizes[pool])]}) == len(sizes[pool])
            assert all(screen[r.image_id][0] == pool for r in mine)
            assert [r.n_near for r in mine[len(sizes[pool]) :]] == [1] * (n - len(sizes[pool]))
        second = [screen[r.image_id] for r in got if r.pool_id == 1][4:7]
        assert len(set(second)) == 3


def test_wanted_takes_further_rounds_over_rows_that_no_pick_covers(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(1, i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(600, 4)))], SCHEMA)
    every = {r.image_id for r in varied_subset(df, block=100).collect()}
    wanted = spark.createDataFrame([(1, len(every))], "pool_id long, k long")
    got = varied_subset(df, wanted=wanted, block=100).collect()
    assert {r.image_id for r in got} == every and sum(r.n_near for r in got) == 600
