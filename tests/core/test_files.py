"""Sources, sinks, the stage loop and the stream, on files of the bundled shapes."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.plans.pipeline import Options, Stage, run
from tracemill.sources import files, sinks
from tracemill.streaming import ingest


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_configs(spark, tmp_path):
    step = {"type": "launch", "parameters": {"command": ["gimp", "/a"], "shell": True}}
    put(tmp_path / "config1.json", json.dumps({"id": "config-1", "config": [step], "provide_info": ["x"]}, indent=1))
    put(tmp_path / "config0.json", json.dumps({"id": "config-0", "config": [{"type": "execute", "parameters": {"command": "ls"}}]}))
    put(tmp_path / "other.json", "{}")
    got = {r.stem: (r.id, r.config[0].parameters.command) for r in files.env_configs(spark, str(tmp_path)).collect()}
    assert got["config0"] == ("config-0", "ls") and set(got) == {"config0", "config1"}
    assert json.loads(got["config1"][1]) == ["gimp", "/a"]  # a list stays the text of its JSON
    assert {r.task_id for r in files.task_configs(spark, str(tmp_path)).collect()} == {"config0", "config1", "other"}
    put(tmp_path / "bad.json", "{broken")
    put(tmp_path / "list.json", "[1]")
    assert {r.stem for r in files.raw_documents(spark, str(tmp_path)).collect()} == {"config0", "config1", "other"}
    with pytest.raises(Exception):
        files.json_documents(spark, str(tmp_path / "bad.json"), "a string").collect()
    with pytest.raises(files.SourceError):
        files.raw_documents(spark, str(tmp_path / "none"))


def test_lines(spark, tmp_path):
    lines = '{"step_num": 1, "action": {"a": 1}, "response": "r"}\n\n{broken\n{"action": "x"}\r\n'
    p = put(tmp_path / "t1" / "traj.jsonl", lines)
    put(tmp_path / "task10" / "traj.jsonl", "")
    got = files.trajectories(spark, p).orderBy("line_no").collect()
    assert [(r.task_id, r.step_num, r.action, r.response) for r in got] == [("t1", 1, '{"a":1}', "r"), ("t1", None, "x", None)]
    with pytest.raises(Exception, match="malformed line 2"):
        files.json_lines(spark, p).collect()
    assert [r.task_id for r in files.discovered_tasks(spark, str(tmp_path)).collect()] == ["t1", "task10"]
    assert files.discovered_tasks(spark, str(tmp_path / "none")).count() == 0


def test_verdict_files(spark, tmp_path):
    p = put(tmp_path / "v.json", json.dumps([{"task_id": "a", "agent_pass": True, "result": {"x": 1}}, {"task_id": "b", "agent_pass": "true"}, {"no": 1}, 3]))
    assert [(r.task_id, r.agent_pass, r.result) for r in files.verify_results(spark, p).orderBy("pos").collect()] == [("a", True, '{"x":1}'), ("b", None, None)]
    assert files.verify_results(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(files.SourceError):
        files.verify_results(spark, str(tmp_path / "none.json"), missing_ok=False)
    bad = put(tmp_path / "bad.json", '{"a": 1}')
    with pytest.raises(Exception, match="no list"):
        files.verify_results(spark, bad).collect()
    assert files.cached_results(spark, bad).count() == 0 and files.cached_results(spark, p).count() == 2


def test_lists_images_scores_env(spark, tmp_path):
    p = put(tmp_path / "s.json", '[" a ", "b", 3, ""]')
    assert [r.path for r in files.screenshot_paths(spark, p, strict=False).orderBy("pos").collect()] == [" a ", "b"]
    with pytest.raises(Exception, match="item 2"):
        files.screenshot_paths(spark, p).collect()
    for n in ("r/a-b/x.PNG", "r/a/z.jpg", "r/a/b.png", "r/a/no.txt"):
        put(tmp_path / n, "x")
    got = [r.path.split("/r/")[1] for r in files.image_files(spark, [str(tmp_path / "r"), str(tmp_path / "r/a"), "/no/such"]).collect()]
    assert got == ["a/b.png", "a/z.jpg", "a-b/x.PNG"]
    assert files.image_files(spark, []).count() == 0
    put(tmp_path / "o/t1/result.txt", " 0.5\n")
    put(tmp_path / "o/t2/result.txt", "oops")
    assert {(r.task_id, r.score) for r in files.scores(spark, str(tmp_path / "o/*/result.txt")).collect()} == {("t1", 0.5), ("t2", 0.0)}
    assert files.env_file("# c\nA='1'\nB=x=y\nbad\n", {"A": "0"}) == {"A": "0", "B": "x=y"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t2", '{"b": 2}', 2), ("t1", '{"é": 1}', 1)], "task_id string, doc string, n int")
    assert sinks.write_list(df, str(tmp_path / "l.json"), ["n"], ["task_id", "n"]) == 2
    assert json.loads((tmp_path / "l.json").read_text()) == [{"task_id": "t1", "n": 1}, {"task_id": "t2", "n": 2}]
    assert sinks.write_list(df.limit(0), str(tmp_path / "e.json"), ["n"]) == 0 and json.loads((tmp_path / "e.json").read_text()) == []
    with pytest.raises(ValueError):
        sinks.write_list(df, str(tmp_path / "m.json"), ["n"], most=1)
    assert sinks.write_per_task(df, str(tmp_path / "tasks"), "task_id", "doc") == 2
    assert (tmp_path / "tasks/t1.json").read_text(encoding="utf-8") == '{\n  "é": 1\n}'
    m = spark.createDataFrame([("d", 1, ["c"]), ("d", 0, ["a", "b"])], "domain string, chunk int, task_ids array<string>")
    sinks.write_manifest(m, str(tmp_path / "m/manifest.json"))
    assert json.loads((tmp_path / "m/manifest.json").read_text()) == {"d": ["a", "b", "c"]}
    reg = str(tmp_path / "info.json")
    put(tmp_path / "info.json", '{"a": 1, "b": 2}')
    sinks.upsert_registry(reg, "a", "x.json")
    known = json.loads((tmp_path / "info.json").read_text())
    assert known["b"] == 2 and known["a"]["file_name"] == "x.json" and list(known) == ["a", "b"]
    put(tmp_path / "i/1.png", "one")
    put(tmp_path / "i/2.png", "two")
    pairs = spark.createDataFrame([(n, str(tmp_path / f"i/{k}.png"), str(tmp_path / "o/x.png")) for n, k in enumerate((1, 2, 1))], "n int, a string, b string")
    assert sinks.copy_images(pairs, "a", "b", ["n"]) == 1 and (tmp_path / "o/x.png").read_text() == "one"  # the last written stays
    sinks.write_lines(df, str(tmp_path / "lines"), ["n"])
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    sinks.append_results(df, str(tmp_path / "res"))
    sinks.append_results(df, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 4
    sinks.write_selection(df, str(tmp_path / "sel"), ["n"], "task_id", {"top_n": 2})
    assert json.loads((tmp_path / "sel/paths.json").read_text()) == ["t1", "t2"]
    with pytest.raises(ValueError):
        sinks.write_selection(df, str(tmp_path / "sel"), ["n"], "task_id", {}, most=1)


def test_stage_loop_is_taken_up_again(spark, tmp_path):
    o = Options(f"file://{tmp_path}/root", steps=("seed", "iter2"))
    stages = [Stage("a", lambda s, read, step: s.range(3)), Stage("b", lambda s, read, step: read(step, "a").selectExpr("id * 2 AS id"), last=False)]
    assert run(spark, o, stages) == [("seed", "a", True), ("seed", "b", True), ("iter2", "a", True)]
    assert not any(made for _, _, made in run(spark, o, stages))
    assert run(spark, o, stages, only=["b"]) == [("seed", "b", False)]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.read.parquet("/root/testdata/sf0.001/trajectory_row.parquet")
    rows.repartition(5).write.parquet(str(src))
    q = ingest.ingest(ingest.stream(spark, str(src), 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = ingest.current(spark, str(tmp_path / "out"))
    want = ingest.keep_first(rows, ingest.KEYS, ["ingested_at"])
    cols = want.columns
    assert got.select(cols).exceptAll(want).isEmpty() and want.exceptAll(got.select(cols)).isEmpty()
    hours = ingest.counts_by_hour(ingest.stream(spark, str(src)))
    h = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    h.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == rows.where("executed_at IS NOT NULL").select(ingest.KEYS).distinct().count()
