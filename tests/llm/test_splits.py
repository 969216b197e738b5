"""Groups of related records against union-find."""

import random
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from tracemill.llm.splits import bare_task, components, file_name, record_entities, related_groups, split_of


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (200, 190), (50, 400)):
        pairs = [(f"{rng.randrange(n):04}", f"{rng.randrange(n):04}") for _ in range(m)] + [(f"{i:04}", f"{i + 1:04}") for i in range(1000, 1060)] + [("9999", f"{i}") for i in range(2000, 2100)]
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
        assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    v, s = spark.read.parquet(f"{d}/verify_result.parquet"), spark.read.parquet(f"{d}/dpo_sample.parquet")
    pairs, least = [], {}
    for r in v.select("verify_id", "task_id").collect():
        least["verify", r.verify_id] = "0" + re.sub(r"\.json$", "", r.task_id.strip().split("/")[-1])
    for r in s.select("sample_id", "images").collect():
        keys = []
        for p in [x for x in r.images or [] if x]:
            name = unquote(p).strip().replace("\\", "/").split("/")[-1].lower()
            keys.append("1" + name)
            if m := re.match(r"(seed|iter\d+)_(.+)_step\d+_input\.png$", name):
                keys.append("0" + m[2])
        if keys:
            least["sample", r.sample_id] = min(keys)
            pairs += [(k, min(keys)) for k in keys]
    top = union_find(pairs)
    want = {k: top.get(x, x)[1:] for k, x in least.items()}
    got = {(r.record_type, r.record_id): r.group_task_id for r in related_groups(record_entities(v, s)).collect()}
    assert got == want


def test_names(spark):
    df = spark.createDataFrame([(" gimp/task1.json\n", "file:///a/../B%5F1.PNG "), (None, None), ("  ", " "), ("\xa0task2", "..\\images\\b_1.png")], "t string, f string")
    got = [tuple(r) for r in df.select(bare_task(F.col("t")), file_name(F.col("f"))).collect()]
    assert got == [("task1", "b_1.png"), (None, None), (None, None), ("task2", "b_1.png")]


def test_empty_and_no_task(spark):
    v = spark.createDataFrame([], "verify_id long, task_id string")
    s = spark.createDataFrame([(1, ["a/x.png", None]), (2, ["X.png"]), (3, None), (4, [])], "sample_id long, images array<string>")
    got = {(r.record_id, r.group_task_id) for r in related_groups(record_entities(v, s)).collect()}
    assert got == {(1, None), (2, None)}


def test_shares(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("g")).select(split_of(F.col("g")).alias("s")).groupBy("s").count()
    n = {r.s: r["count"] / 20000 for r in df.collect()}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["validation"] - 0.1) < 0.02 and abs(n["test"] - 0.1) < 0.02
