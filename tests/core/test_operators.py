"""Gates, votes, resuming, mining, tasks, vectors and models on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import dedupe, mining, models, resume, tasks, vectors, verdicts

V = "verify_id long, task_id string, agent_pass boolean, extra string"


def test_gates_differ(spark):
    teacher = spark.createDataFrame([(i, f"t{i}", True, None) for i in range(4)], V)
    student = spark.createDataFrame([(0, "t0", False, None), (1, "t1", True, None), (2, "t2", None, None)], V)
    strict = verdicts.weakness_pairs(student, teacher, ["task_id"], ["verify_id"])
    assert [r.task_id for r in strict.collect()] == ["t0"]
    t = spark.createDataFrame([("d", f"t{i}") for i in range(5)], "domain string, task_id string")
    assert sorted(r.task_id for r in verdicts.gate(t, teacher, student, ["verify_id"]).collect()) == ["t0", "t2", "t3"]
    prefixed = spark.createDataFrame([(1, "d/t1", None, None), (2, "t1", True, None)], V)
    assert verdicts.gate(t, prefixed, student, ["verify_id"]).count() == 0
    twice = spark.createDataFrame([(1, "t0", True, None), (2, "t0", False, None)], V)
    assert verdicts.weakness_pairs(student, twice, ["task_id"], ["verify_id"]).count() == 1
    assert verdicts.gate(t, twice, student, ["verify_id"]).count() == 0


def test_passed_keys_are_not_broadcast(spark):
    """The keys a teacher passed grow with its verdicts, whatever size is guessed for them."""
    v = spark.range(4).select(F.col("id").alias("verify_id"), F.concat(F.lit("t"), "id").alias("task_id"), (F.col("id") % 2 == 0).alias("agent_pass"))  # of known, small size
    got = verdicts.weakness_pairs(v, v.withColumn("agent_pass", F.lit(True)), ["task_id"], ["verify_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" not in plan, plan
    assert sorted(r.task_id for r in got.collect()) == ["t1", "t3"]


def test_vote(spark):
    a = [(3, True, "c"), (1, True, "a"), (2, False, "b")]
    df = spark.createDataFrame([(1, a), (2, [(1, True, "x")]), (3, None), (4, []), (5, [(1, None, "n")])], "i int, a array<struct<attempt:int,agent_pass:boolean,result:string>>")
    got = {r.i: r.v and tuple(r.v) for r in df.select("i", verdicts.vote(F.col("a")).alias("v")).collect()}
    assert got == {1: (False, 2, "b"), 2: (True, 1, "x"), 3: None, 4: None, 5: (False, 1, "n")}


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert {tuple(r) for r in dedupe.keep_first(df, ["k"], ["o"]).collect()} == {("a", 1, "x"), (None, 4, "m")}
    assert {tuple(r) for r in dedupe.keep_last(df, ["k"], ["o"]).collect()} == {("a", 2, None), (None, 5, "n")}
    assert dedupe.keep_first(df.limit(0), ["k"], ["o"]).count() == 0


def test_resume(spark):
    t = spark.createDataFrame([("a",), ("b",), (None,)], "task_id string")
    done = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "task_id string")
    assert {r.task_id for r in resume.unfinished(t, done, ["task_id"]).collect()} == {"b", None}
    assert {(r.task_id, r.reused) for r in resume.cache_split(t, done, ["task_id"]).collect()} == {("a", True), ("b", False), (None, False)}
    with pytest.raises(resume.ExpectationError, match="missing: b"):
        resume.expect_complete(t.where("task_id IS NOT NULL"), done, ["task_id"])
    with pytest.raises(resume.ExpectationError):
        resume.expect_equal_counts(t, t.limit(1))


def test_mining(spark):
    from tracemill.schemas import CONFIG_STEP

    p = lambda **k: {"command": None, "files": None, "path": None, "seconds": None, "shell": None, "window_name": None} | k
    config = [
        {"type": "download", "parameters": p(files=[{"url": "u", "path": "/home/user/b.mp4"}, {"url": "u", "path": None}])},
        {"type": "launch", "parameters": p(command='["vlc", "/home/user/a.jpg", "--x", "~/c"]')},
        {"type": "launch", "parameters": p(command="vlc /home/user/no.jpg", shell=True)},
        {"type": "execute", "parameters": p(command='["sh", "-c", "cp /home/user/d/e.txt /home/user/f-1+2"]')},
        {"type": "open", "parameters": p(path="/home/user/open.txt")},
        {"type": "launch", "parameters": p(command='["gimp"]')},
    ]
    df = spark.createDataFrame([(config, ["see /home/user/b.mp4", " "]), (None, None), ([], [])], f"c array<{CONFIG_STEP}>, i array<string>")
    got = df.select(mining.declared_paths(F.col("c"), F.col("i")).alias("p"), mining.bare_launch(F.col("c")).alias("b")).collect()
    assert got[0].p == ["/home/user/a.jpg", "/home/user/b.mp4", "/home/user/d/e.txt", "/home/user/f-1+2", "~/c"] and got[0].b
    assert (got[1].p, got[1].b, got[2].p, got[2].b) == ([], False, [], False)
    docs = [(1, '{"instruction": "root", "parsed": {"queries": [{"instruction": "a"}, {"instruction": 3}, 7]}, "per_config": [{"parsed": {"queries": [{"instruction": " "}, {"instruction": "b"}]}}, {}]}'), (2, "[1]"), (3, None), (4, "{broken")]
    rows = mining.document_instructions(spark.createDataFrame(docs, "k int, j string"), ["k"], "j").orderBy("pos").collect()
    assert [(r.k, r.instruction) for r in rows] == [(1, "root"), (1, "a"), (1, "b")]


def test_tasks(spark):
    q = spark.createDataFrame([('{"reference_config_id": null}',), ('{"reference_config_id": ""}',), ("{}",), ('{"reference_config_id": "r", "targets_student_gaps": ["g"]}',)], "q string")
    assert [r.r for r in q.select(tasks.default_reference(F.col("q"), F.lit("block")).alias("r")).collect()] == [None, "", "block", "r"]
    assert q.select(tasks.without_gaps(F.col("q")).alias("r")).collect()[3].r == '{"reference_config_id":"r"}'
    nested = spark.createDataFrame([('{"a": [1, {"b": null}], "targets_student_gaps": [], "n": null}',)], "q string")
    assert nested.select(tasks.without_gaps(F.col("q")).alias("r")).first().r == '{"a":[1,{"b":null}],"n":null}'
    ids = spark.createDataFrame([(None, "b"), ("", "b"), ("a", "b"), ("", "")], "r string, o string")
    assert [r.c for r in ids.select(tasks.config_id(F.col("r"), F.col("o")).alias("c")).collect()] == ["b", "b", "a", None]
    queries = spark.createDataFrame([(2, "f1", "c", "do b"), (1, "f2", "c", "do a"), (3, "f1", "c", "")], "o int, config_file string, config_id string, instruction string")
    n = tasks.numbered_tasks(queries, ["o"])
    configs = spark.createDataFrame([("f1", "x", None, "snap"), ("f2", "y", "base", "snap")], "config_file string, id string, instruction string, snapshot string")
    got = {r.id: (r.config_id, r.instruction, r.snapshot) for r in tasks.materialize(n, configs).collect()}
    assert got == {"task1": ("c", "base", "snap"), "task2": ("c", "do b", "snap")}
    with pytest.raises(resume.ExpectationError):
        tasks.materialize(n, configs.limit(0))
    m = tasks.manifest(spark.createDataFrame([("d", f"t{i:02}") for i in range(7)], "domain string, task_id string"), ["domain"], chunk=3)
    assert [r.task_ids for r in m.orderBy("chunk").collect()] == [["t00", "t01", "t02"], ["t03", "t04", "t05"], ["t06"]]
    up = tasks.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert {tuple(r) for r in up.collect()} == {("a", 9), ("b", 2)}


def plain_farthest(x, n, seed):
    picks, least = [seed], 1 - x @ x[seed]
    while len(picks) < n:
        least[picks] = -1
        picks.append(int(np.argmax(least)))
        least = np.minimum(least, 1 - x @ x[picks[-1]])
    return picks


def test_lookups_and_limits(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "task_id string")
    doc = "stem string, json string, path string"
    one = spark.createDataFrame([("a", '{"instruction": " x "}', "1/a"), ("b", "{broken", "1/b"), ("c", '{"instruction": null}', "1/c")], doc)
    two = spark.createDataFrame([("a", '{"instruction": "y"}', "2/a"), ("b", '{"instruction": "z"}', "2/b"), ("d", '{"id": 1}', "2/d")], doc)
    got = {r.task_id: (r.instruction, r.path) for r in tasks.instruction_lookup(t, [one, two]).collect()}
    assert got == {"a": ("x", "1/a"), "b": ("z", "2/b"), "c": ("None", "1/c"), "d": ("", "2/d"), "e": (None, None)}
    assert [r.task_id for r in tasks.first_ids(t, 2).collect()] == ["a", "b"] and tasks.first_ids(t, 0).count() == tasks.first_ids(t, None).count() == 5
    f = resume.finished_ids(spark.createDataFrame([("d", "b"), ("d", "a"), ("d", "a"), (None, "c"), ("e", None)], "domain string, task_id string"))
    assert sorted((str(r.domain), r.n, tuple(r.task_ids)) for r in f.collect()) == [("None", 1, ("c",)), ("d", 2, ("a", "b"))]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 1, [1.0, 0.0]), (3, 1, None), (3, 2, [0.0])], "pool_id long, image_id long, embedding array<double>")
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5].mean(1)
    for block in (1024, 16):
        got = {(r.pool_id, r.image_id): r.uniqueness for r in vectors.neighbour_uniqueness(df, "pool_id", "image_id", "embedding", 5, block).collect()}
        assert len(got) == 91 and got[2, 1] == 0 and all(abs(got[1, i] - want[i]) < 1e-9 for i in range(90))
    seeds = spark.createDataFrame([(1, 7), (2, 1)], "pool_id long, image_id long")
    n = spark.createDataFrame([(1, 12), (2, 5)], "pool_id long, n long")
    for block in (1024, 16):
        got = vectors.farthest_points(df, seeds, n, "pool_id", "image_id", "embedding", block).orderBy("pool_id", "pick_no").collect()
        assert [r.image_id for r in got if r.pool_id == 1] == plain_farthest(u, 12, 7)
        assert [r.image_id for r in got if r.pool_id == 2] == [1]
        all_ = vectors.farthest_points(df, seeds, n.withColumn("n", F.lit(500).cast("long")), "pool_id", "image_id", "embedding", block)
        assert [r.image_id for r in all_.where("pool_id = 1").orderBy("pick_no").collect()] == list(range(90))
    best = vectors.diverse_samples(df, n, "pool_id", "image_id", "embedding", 5).where("pool_id = 1").orderBy("rank").collect()
    assert {r.image_id for r in best} == set(plain_farthest(u, 12, int(np.argmax(want)))) and [r.uniqueness for r in best] == sorted((r.uniqueness for r in best), reverse=True)
    sel = spark.createDataFrame([(1, [3, 3, 99, -1, 0, None], 10)], "pool_id long, indices array<int>, total int")
    assert [tuple(r)[1:] for r in vectors.valid_indices(sel, ["pool_id"], "indices", "total").orderBy("pos").collect()] == [(1, 3), (2, 0)]


def test_farthest_points_of_many_blocks(spark):
    """More rows a block than are named a round, and rows that tie."""
    x = np.random.default_rng(1).normal(size=(600, 5))
    x[100:110] = x[100]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "pool_id long, image_id long, embedding array<double>")
    one = lambda n, name: spark.createDataFrame([(1, n)], f"pool_id long, {name} long")
    got = vectors.farthest_points(df, one(7, "image_id"), one(120, "n"), "pool_id", "image_id", "embedding", 200).orderBy("pick_no").collect()
    assert [r.image_id for r in got] == plain_farthest(u, 120, 7)


def test_models(spark):
    prompts = spark.createDataFrame([("t1", "p1"), ("t2", "p2"), ("t3", "p3")], "task_id string, prompt string")
    sha = lambda p: F.sha2(F.lit(p), 256)
    ok, no = '{"agent_pass": true}', '{"agent_pass": false}'
    rows = [("judge", "p1", a, r, None) for a, r in ((1, ok), (2, no), (3, ok))] + [("judge", "p2", 1, None, "timeout"), ("rank", "p3", 1, ok, None)]
    resp = spark.createDataFrame(rows, "stage string, prompt string, attempt int, output_text string, error string").withColumn("prompt_sha", F.sha2("prompt", 256))
    got = {r.task_id: (r.agent_pass, r.num_attempts, r.error) for r in models.judged(models.recorded(prompts, resp, "judge"), ["task_id"]).collect()}
    assert got == {"t1": (False, 2, None), "t2": (None, None, "timeout"), "t3": (None, None, "no recorded answer")}
    with pytest.raises(Exception, match="judge: "):
        models.recorded(prompts, resp, "judge", fail_fast=True).collect()
    live = models.called(prompts, lambda: lambda ps: [(p.upper(), None) for p in ps])
    assert {r.output_text for r in live.collect()} == {"P1", "P2", "P3"}
    gen = models.parsed_generation(spark.createDataFrame([("```json\n{\"queries\": []}\n```",), ("[1]",), (None,)], "output_text string")).collect()
    assert [(r.parsed, r.parse_error is None) for r in gen] == [('{"queries": []}', True), (None, False), (None, False)]
    steps = spark.createDataFrame([("t", 1, i, f"r{i}", f"s{i}") for i in range(3)], "task_id string, run_no long, step long, response string, input_screenshot string")
    out = models.forced_replay(steps, lambda h, s: (" ".join(x["response"] for x in h), s["screenshot"]), 2).orderBy("step").collect()
    assert [(r.student_response, r.student_action) for r in out] == [("", "s0"), ("r0", "s1"), ("r0 r1", "s2")]
    images = spark.createDataFrame([("a", b"12"), ("b", b"")], "path string, content binary")
    vec = models.embedded(images, lambda: lambda bs: [[3.0, 4.0] if b else None for b in bs]).collect()
    assert [(r.path, r.embedding) for r in vec] == [("a", [0.6, 0.8])]
