"""Preference samples against brute force on a small set of tables."""

import re

import __spark_entry__ as entry

CALL = '<tool_call>\n{{"name": "computer_use", "arguments": {{"action": "key", "keys": ["{}"]}}}}\n</tool_call>'
INTENT = r"(?:(?<=\.)\s*|(?<=\n)\s*|^)((?:I'll|I will|Let me|Now I(?:'ll| will| need to| should| am going to| want to))\s.+)$"
# Words before the call: tagged, tag alone, action line alone, intents, none, no words.
WORDS = ["<think>Seen.</think>\nAction: Press it.\n", "It is open.\n</think>\n", "Action: Press it.\n", "The menu is open. I'll press it.\n", "Let me press it\n", "Done so far\nNow I need to press. It waits.\n", "Nothing to tell\n", ""]
VERDICT = "verify_id long, step string, domain string, agent string, task_id string, instruction string, agent_pass boolean, result string, error string, judged_at timestamp"
SIDE = "struct<role: string, content: string>"
SAMPLE = f"sample_id long, chosen {SIDE}, rejected {SIDE}, images array<string>"
IMAGE = "/data/seed_task1_step2_input.png"


def tables(spark, folder, samples, verdicts=((1, "teacher", "task1", True), (2, "student", "task1", False)), tasks=("task1", "task2")):
    spark.createDataFrame([(i, "seed", "d", a, t, "Do it", p, None, None, None) for i, a, t, p in verdicts], VERDICT).write.parquet(f"{folder}/verify_result.parquet")
    spark.read.parquet("/root/testdata/sf0.001/task_config.parquet").limit(0).unionByName(spark.createDataFrame([("seed", "d", t, "c", f"Do {t}") for t in tasks], "step string, domain string, task_id string, config_id string, instruction string"), allowMissingColumns=True).write.parquet(f"{folder}/task_config.parquet")
    spark.createDataFrame([(i, c and ("assistant", c), r and ("assistant", r), m) for i, (c, r, m) in enumerate(samples)], SAMPLE).write.parquet(f"{folder}/dpo_sample.parquet")
    spark.createDataFrame([], "task_id string, agent string").write.parquet(f"{folder}/trajectory_row.parquet")
    return str(folder)


def answer(content):
    """The reference's parsing and layout, in plain Python."""
    find = lambda p, f=0: (m := re.search(p, content, f)) and m[1].strip()
    thought = find(r"<think>\s*(.*?)\s*</think>", re.S)
    thought = find(r"^(.*?)\s*</think>", re.S) if thought is None else thought
    action, tools = find(r"Action:\s*(.+)"), re.findall(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", content, re.S)
    if thought is None and action is None:
        t = re.sub(r"<tool_call>.*?</tool_call>", "", content, flags=re.S).strip()
        m = re.search(INTENT, t, re.S | re.I)
        thought, action = (t[: m.start(1)].strip().rstrip(".").strip(), m[1].strip()) if m else (t, None)
    return f"<think>{thought or ''}\n</think>\n\nAction: {action or ''}\n" + "\n".join(f"<tool_call>\n{x}\n</tool_call>" for x in tools)


def test_answers_without_tag_and_action_line_are_kept(spark, tmp_path):
    samples = [(c + CALL.format("a"), r + CALL.format("b"), [IMAGE]) for c in WORDS for r in WORDS]
    samples += [("No call. I'll wait.", CALL.format("b"), [IMAGE]), (None, CALL.format("b"), [IMAGE]), (CALL.format("a"), CALL.format("a"), [IMAGE])]
    d = tables(spark, tmp_path, samples)
    want = {i: (answer(c), answer(r)) for i, (c, r, _) in enumerate(samples[:-3])}
    assert {r.sample_id: (r.chosen, r.rejected) for r in entry.queries()["preference_samples"](spark, d).collect()} == want
    assert entry.catalog.FLAGSHIP == "preference_samples"


def test_task_of_the_first_image_that_names_one(spark, tmp_path):
    named = [r"..\images\seed_Task1_step2_input.png", "seed_Task1_step2_input.png", "/m/seed%5FTask1%5Fstep2%5Finput.png", "/m/SEED_TASK1_STEP2_INPUT.PNG", "/m/seed_Task1_step2_input.png "]
    images = [[x] for x in named] + [["/m/shot_1.png", x] for x in named] + [[None, named[0], "/m/seed_task2_step1_input.png"]]
    none = [["/m/shot_1.png"], [], None, ["/m/seed_task2_step1_input.png", named[0]]]
    samples = [(CALL.format("a"), CALL.format("b"), m) for m in images + none]
    d = tables(spark, tmp_path, samples, ((1, "teacher", "Task1", True), (2, "student", "Task1", False)), ("Task1", "task2"))
    got = {r.sample_id: (r.task_id, r.image) for r in entry.queries()["preference_samples"](spark, d).collect()}
    assert got == {i: ("Task1", next(x for x in m if x in named)) for i, m in enumerate(images)}


def test_task_ids_are_brought_in_line(spark, tmp_path):
    v = [(1, "teacher", "d/t1", True), (2, "student", "t1.json", False), (3, "teacher", " t2.json", True), (4, "student", "d/t2.json", True), (5, "student", "t2", False), (6, "teacher", "t3", True), (7, "student", "d/t3", False), (8, "student", "t3", True)]
    d = tables(spark, tmp_path, [(CALL.format("a"), CALL.format("b"), [f"/m/seed_{t}_step2_input.png"]) for t in ("t1", "t2", "t3")], v, ("t1", "t2", "t3", "t4"))
    q = lambda name, c="task_id": sorted(r[c] for r in entry.queries()[name](spark, d).collect())
    # of the gate's rows of a task, those with the domain in front go first
    assert q("preference_gate") == ["t1", "t3"] and q("preference_samples", "sample_id") == [0, 2]
    assert q("weakness_pairs", "verify_id") == [2, 5, 7] and q("case_texts", "case_no") == [1, 2, 3]
    assert q("unfinished_tasks") == ["t4"]
    # no trajectories are there at all; of t3's agents both have a verdict
    missing = {tuple(r) for r in entry.queries()["missing_results"](spark, d).collect()}
    assert {x for x in missing if x[2] == "verdict"} == {("t4", "student", "verdict"), ("t4", "teacher", "verdict")}
    assert len({x for x in missing if x[2] == "trajectory"}) == 8
    assert {r.task_id: r.reused for r in entry.queries()["cache_split"](spark, d).collect()} == {"t1": True, "t2": True, "t3": True, "t4": False}
