"""A run of two steps from seed tasks to preference samples, on recorded answers."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators.resume import ExpectationError
from tracemill.plans import stages
from tracemill.plans.pipeline import Options, run

CALL = '<think>See.</think>\nAction: Press it\n<tool_call>\n{{"name": "computer_use", "arguments": {{"action": "key", "keys": ["{}"]}}}}\n</tool_call>'
LINE = "task_id string, agent string, run_no long, line_no long, step_num long, response string, action string, screenshot_file string, ingested_at timestamp"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def lines(tasks):
    out = []
    for t in tasks:
        for agent, key in (("student", "b"), ("teacher", "a")):
            out += [(t, agent, 1, n, n, CALL.format(key), f"press {key}", f"step_{n}.png", None) for n in (1, 2)]
    return out


def answer(spark, o, step, stage, name, make):
    """Records ``make(row)`` as the answer to every prompt of a stage."""
    rows = [(name, F.sha2, r) for r in stages.prompts(spark, o, step, stage).withColumn("sha", F.sha2("prompt", 256)).collect()]
    got = [(name, r.sha, n, text, None) for _, _, r in rows for n, text in enumerate(make(r), 1)]
    spark.createDataFrame(got, schemas.MODEL_RESPONSE).coalesce(1).write.mode("append").parquet(f"{o.root}/recorded")
    return rows


def test_seed_to_samples(spark, tmp_path):
    o = Options(f"file://{tmp_path}/run", steps=("seed", "iter2"), top_n=2, queries_per_config=2, extra={"select_count": 2})
    config = [{"type": "launch", "parameters": {"command": "[\"gimp\"]"}}]
    known = "domain string, config_file string, config_id string, provide_info array<string>, config array<" + schemas.CONFIG_STEP + ">"
    put(spark, f"{o.root}/configs", [("gimp", "config1.json", "config-1", ["x"], config), ("gimp", "config2.json", "config-2", None, None)], known)
    put(spark, f"{o.root}/recorded", [], schemas.MODEL_RESPONSE)
    put(spark, f"{o.root}/step=seed/tasks", [("gimp", "seed1", "Do  one"), ("gimp", "seed2", "Do two"), ("gimp", "seed3", None)], "domain string, task_id string, instruction string")
    verdict = lambda ok: json.dumps({"agent_pass": ok, "agent_failure_analysis": " lost "})
    for step, names in (("seed", ["seed1", "seed2", "seed3"]), ("iter2", ["task1", "task2", "task3", "task4"])):
        reg = stages.registry(spark, o)
        only = lambda *n: run(spark, Options(o.root, (step,) if step == "seed" else o.steps, extra=o.extra, top_n=2, queries_per_config=2), [reg[x] for x in n])
        if step == "seed":
            with pytest.raises(ExpectationError, match="trajectory of seed is missing"):
                reg["preflight"].make(spark, None, "seed")
        put(spark, f"{o.root}/step={step}/images", [("gimp", f"/s/{i}.png", [float(i == 0), 1.0, float(i)]) for i in range(4)] + [("gimp", "/s/0.png", [1.0, 1.0, 0.0])], "domain string, path string, embedding array<double>")
        put(spark, f"{o.root}/step={step}/trajectory", lines(names[:-1]), LINE)
        with pytest.raises(ExpectationError, match=names[-1]):
            reg["preflight"].make(spark, None, step)
        put(spark, f"{o.root}/step={step}/trajectory", lines(names), LINE)
        made = lambda *n: [reg[x].make(spark, None, step).write.mode("overwrite").parquet(f"{o.root}/step={step}/{x}") for x in n]
        assert {r.agent: r["count"] for r in reg["preflight"].make(spark, None, step).collect()} == {"student": len(names), "teacher": len(names)}
        # the teacher passes all but the second task, in two attempts of three; the student passes the third alone, and its first verdict is no JSON
        answer(spark, o, step, "verify_teacher", "judge", lambda r: [verdict(r.task_id != names[1])] * 2)
        answer(spark, o, step, "verify_student", "judge", lambda r: ["```broken"] if r.task_id == names[1] else [verdict(r.task_id == names[2])])
        made("verify_student", "verify_teacher")
        got = {r.task_id: (r.agent_pass, r.num_attempts, r.error) for r in spark.read.parquet(f"{o.root}/step={step}/verify_teacher").collect()}
        assert got[names[0]] == (True, 2, None) and got[names[1]] == (False, 1, None)
        [(_, _, p)] = answer(spark, o, step, "strategy", "strategy", lambda r: ['```json\n{"summary": "s", "gaps": []}\n```'])
        assert "[Case 1]\ntask_id: " + names[0] in p.prompt and "student_failure_analysis: lost" in p.prompt and "(no cases)" not in p.prompt
        made("strategy", "unique_screenshots")
        [(_, _, p)] = answer(spark, o, step, "rank", "rank", lambda r: ['{"selected_indices": [1, 1, 7, 0], "reasons": [{"index": 0, "reason": "old"}, {"index": 0, "reason": "new"}]}'])
        assert p.prompt.count("Image ") == 2
        made("rank")
        assert [(r["index"], r.reason) for r in spark.read.parquet(f"{o.root}/step={step}/rank").orderBy("pos").collect()] == [(1, ""), (0, "new")], spark.read.parquet(f"{o.root}/step={step}/unique_screenshots").collect()
        if step == "seed":
            query = lambda i: {"instruction": f"New {i}", "reference_config_id": "config-9", "targets_student_gaps": ["g"]}
            rows = answer(spark, o, step, "generate_nofail", "generate", lambda r: ["```json\n" + json.dumps({"queries": [query(r.config_id), query("x" + r.config_id)]}) + "\n```"])
            assert all("- Do one\n- Do two" in r.prompt and "Configuration:" in r.prompt for _, _, r in rows) and "A program starts without a file." in "".join(r.prompt for _, _, r in rows)
            with pytest.raises(Exception, match="no recorded answer"):
                made("generate_fail")
            rows = answer(spark, o, step, "generate_fail", "generate", lambda r: ["no JSON"] if r.config_id == "config-2" else [json.dumps({"queries": [{"instruction": ""}]})])
            assert all('{"summary"' in r.prompt for _, _, r in rows)
            made("generate_nofail", "generate_fail", "prepare_next")
            errors = {r.config_id: list(r.errors) for r in spark.read.parquet(f"{o.root}/step=seed/generate_fail").collect()}
            assert errors == {"config-1": ["1 queries in place of 2"], "config-2": ["the answer is no JSON object"]}
            new = spark.read.parquet(f"{o.root}/step=seed/prepare_next").orderBy("task_id").collect()
            assert [(r.task_id, r.config_id, r.instruction, r.domain) for r in new] == [("task1", "config-9", "New config-1", "gimp"), ("task2", "config-9", "New xconfig-1", "gimp"), ("task3", "config-9", "New config-2", "gimp"), ("task4", "config-9", "New xconfig-2", "gimp")]
        answer(spark, o, step, "replay", "replay", lambda r: [CALL.format("b" if r.step == 1 else "a")])
        made("replay", "preference")
        assert spark.read.parquet(f"{o.root}/step={step}/replay").where("error IS NULL").count() == 2 * len(names)
    samples = stages.all_samples(spark, o).orderBy("n").collect()
    # the teacher passed and the student did not: the first task of either step, and iter2's fourth; the second step's call is the same
    assert [(r.n, r.task_id, r.step, r.learn_type, r.images[0]) for r in samples] == [(1, "seed1", 1, "learn_param", "seed_seed1_step1_input.png"), (2, "task1", 1, "learn_param", "iter2_task1_step1_input.png"), (3, "task4", 1, "learn_param", "iter2_task4_step1_input.png")]
    assert '"keys": ["a"]' in samples[0].chosen.content and '"keys": ["b"]' in samples[0].rejected.content and "Do  one" in samples[0].conversations[1].content
    # a run over what is there makes nothing again
    assert not any(now for _, _, now in run(spark, o, [x for n, x in stages.registry(spark, o).items() if n != "preflight"]))
