"""Steps of runs against plain Python."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracemill.operators.ranks import balanced_shards, number_rows
from tracemill.operators.steps import delivered_once, group_by_step, history, input_screenshot, merge_consecutive

SCHEMA = "task_id string, run_no long, line_no long, step_num long, response string, action string, screenshot_file string, ingested_at timestamp"


def rows(numbers, task="t"):
    return [(task, 1, i, n, f"r{i}", f"a{i}", f"s{i}", None) for i, n in enumerate(numbers)]


def test_null_steps_merge_with_each_other_only(spark):
    got = merge_consecutive(spark.createDataFrame(rows([None, None, 1, 1, 2, 1]), SCHEMA)).orderBy("group_no").collect()
    assert [(r.step_num, r.n_lines, r.response, r.action, r.screenshot_file) for r in got] == [(None, 2, "r0", "a0\na1", "s1"), (1, 2, "r2", "a2\na3", "s3"), (2, 1, "r4", "a4", "s4"), (1, 1, "r5", "a5", "s5")]


def test_grouping_takes_missing_as_zero(spark):
    got = group_by_step(spark.createDataFrame(rows([None, None, 1, 1, 2, 1]), SCHEMA)).orderBy("step").collect()
    assert [(r.step, len(r.actions), r.response, r.screenshot_file) for r in got] == [(0, 2, "r0", "s1"), (1, 3, "r2", "s5"), (2, 1, "r4", "s4")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([None, 1, 2]), max_size=40), st.sampled_from([1, 3, 7, 4096]))
def test_merging_agrees_with_plain_python(spark, numbers, segment):
    want = []
    for i, n in enumerate(numbers):
        if want and want[-1][0] == n:
            want[-1][1] += 1
        else:
            want.append([n, 1])
    got = merge_consecutive(spark.createDataFrame(rows(numbers), SCHEMA), segment=segment).orderBy("group_no").collect()
    assert [[r.step_num, r.n_lines] for r in got] == want and [r.group_no for r in got] == list(range(1, len(want) + 1))


def test_inputs_and_history(spark):
    data = [("t", 1, 1, None, "a"), ("t", 1, 2, "r2", None), ("t", 1, 3, "r3", "c"), ("t", 2, 1, "x", "d")]
    s = spark.createDataFrame(data, "task_id string, run_no long, step long, response string, screenshot_file string")
    assert [r.input_screenshot for r in input_screenshot(s).orderBy("run_no", "step").collect()] == ["a", "a", None, "d"]
    assert [r.history for r in history(s, 1).orderBy("run_no", "step").collect()] == [[], [""], ["r2"], []]


def test_history_over_segments(spark):
    at = [0, 1, 3, 4, 9, 10, 11, 12, 25, 26, 40]
    data = [("t", 1, i, None if i % 4 == 1 else f"r{i}", f"f{i}") for i in at] + [("u", None, i, f"x{i}", None) for i in (2, 7)]
    s = spark.createDataFrame(data, "task_id string, run_no long, step long, response string, screenshot_file string")
    texts = ["" if i % 4 == 1 else f"r{i}" for i in at]
    for segment in (1, 3, 100):
        got = history(s, 3, segment=segment).where("task_id = 't'").orderBy("step").collect()
        assert [r.history for r in got] == [texts[max(0, k - 3) : k] for k in range(len(at))]
        got = input_screenshot(s, segment=segment).orderBy("task_id", "step").collect()
        assert [r.input_screenshot for r in got] == ["f0"] + [f"f{i}" for i in at[:-1]] + [None, None]
    assert history(s.limit(0)).count() == 0


def test_deliveries(spark):
    data = [("t", 1, 0, 1, "late", "x", "s", None), ("t", 1, 0, 1, "late", "x", "s", None), (None, None, 0, None, None, None, None, None)]
    assert delivered_once(spark.createDataFrame(data, SCHEMA)).count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert merge_consecutive(empty).count() == 0 and group_by_step(empty).count() == 0


def test_action_texts(spark):
    data = [("t", 1, 0, 1, None, None, None, None), ("t", 1, 1, 1, None, '{"a":[1,2],"b":"é"}', None, None), ("t", 1, 2, 1, None, "  x() ", None, None), ("t", 1, 3, 1, None, "{broken", None, None)]
    assert merge_consecutive(spark.createDataFrame(data, SCHEMA)).first().action == '{"a": [1, 2], "b": "é"}\nx()\n{broken'


def test_numbers_and_shards(spark):
    rng = random.Random(0)
    ids = rng.sample(range(10**6), 1003)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(9)
    assert [r.n for r in number_rows(df, ["id"]).orderBy("id").collect()] == list(range(1, 1004))
    sizes = [r["count"] for r in balanced_shards(spark.range(11), ["id"], 4).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [3, 3, 3, 2]
    assert balanced_shards(spark.range(0), ["id"], 4).count() == 0 and number_rows(spark.range(0), ["id"]).count() == 0
    assert [r.shard for r in balanced_shards(spark.range(2), ["id"], 5).orderBy("id").collect()] == [1, 2]
