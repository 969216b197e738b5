"""Runs of the same action, against a plain reader of the notations."""

import ast
import json
import random
import re

from pyspark.sql import Row

from tracemill.llm.runs import collapse_runs

NAMES = {"click": "left_click", "doubleClick": "double_click", "rightClick": "right_click", "tripleClick": "triple_click", "moveTo": "mouse_move", "typewrite": "type", "write": "type", "press": "key", "hotkey": "key"}
SCHEMA = "task_id string, run_no bigint, line_no bigint, action string, executed_at timestamp, ingested_at timestamp, step_num bigint, kind string"


def read(a):
    try:
        j = json.loads(a)
        j = j.get("arguments", j)
        return j["action"], tuple(j.get("coordinate") or ()), j.get("text"), tuple(k.lower() for k in j.get("keys") or ()), j.get("pixels", j.get("time")), j.get("status")
    except ValueError:
        c = ast.parse(a.strip().rstrip(";")).body[0].value
        name = NAMES.get(c.func.attr, {"sleep": "wait"}.get(c.func.attr, c.func.attr))
        vals = [ast.literal_eval(x) for x in c.args]
        kw = {k.arg: ast.literal_eval(k.value) for k in c.keywords}
        if name == "key":
            return name, (), None, tuple(x.lower() for x in vals), None, None
        if name == "type":
            return name, (), vals[0], (), None, None
        if name in ("scroll", "wait"):
            return name, (), None, (), vals[0], None
        if name == "terminate":
            return name, (), None, (), None, vals[0]
        return name, tuple(vals) or (kw["x"], kw["y"]), None, (), None, None


def same(a, b):
    return a[0] == b[0] and a[2:] == b[2:] and len(a[1]) == len(b[1]) and all(abs(x - y) <= 20 for x, y in zip(a[1], b[1]))


def brute(rows):
    by = {}
    for r in rows:
        if r["action"] and r["action"].strip():
            by.setdefault((r["task_id"], r["run_no"]), {})[r["line_no"]] = read(r["action"])
    out = set()
    for key, lines in by.items():
        run = []
        for n in [*sorted(lines), None]:
            if run and (n is None or not same(lines[run[-1]], lines[n])):
                if len(run) > 1:
                    out.add((*key, run[0], run[-1]))
                run = []
            run.append(n)
    return out


def found(df, **kw):
    return {(r.task_id, r.run_no, r.first_line_no, r.last_line_no) for r in collapse_runs(df, **kw).where("n_rows >= 2").collect()}


def test_small_table_against_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/trajectory_row.parquet")
    want = brute(t.select("task_id", "run_no", "line_no", "action").collect())
    assert want and found(t) == want
    assert found(t, segment=3) == want


def test_one_run_of_many_segments(spark):
    rng = random.Random(1)
    rows = [Row(task_id="t", run_no=1, line_no=i * 2, action=f"pyautogui.click({x}, 5)", executed_at=None, ingested_at=None, step_num=None, kind="x") for i, x in enumerate(rng.choice((1, 15, 100)) for _ in range(500))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r.asDict() for r in rows])
    for seg in (1, 2, 7, 64, 5000):
        assert found(df, segment=seg) == want


def test_edges(spark):
    rows = [("t", 1, 0, None, None, None, None, None), ("t", 1, 1, " \n", None, None, None, None), ("t", 1, 2, "{broken", None, None, None, None), ("t", 1, 3, " {broken ", None, None, None, None), ("t", 1, 4, "x" * 100000, None, None, None, None), ("t", 1, 4, "x" * 100000, None, None, None, None)]
    got = [(r.kind, r.first_line_no, r.last_line_no, r.n_rows, r.duration_s) for r in collapse_runs(spark.createDataFrame(rows, SCHEMA)).orderBy("first_line_no").collect()]
    assert got == [("other", 2, 3, 2, None), ("other", 4, 4, 1, None)]
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_count_and_duration(spark):
    rows = [("t", 1, i, a, None, None, None, None) for i, a in enumerate(['{"action": "key", "keys": ["CTRL", "a"]}', 'pyautogui.hotkey("ctrl","A")', "pyautogui.press('a')"])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("task_id", "run_no", "line_no", "action", "timestamp_seconds(line_no * 3) AS executed_at", "ingested_at")
    got = [(r.first_line_no, r.last_line_no, r.n_rows, r.duration_s) for r in collapse_runs(df).orderBy("first_line_no").collect()]
    assert got == [(0, 1, 2, 3.0), (2, 2, 1, 0.0)]
