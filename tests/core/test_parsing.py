"""Answers, calls and judges' texts."""

from pyspark.sql import functions as F

from tracemill.functions import actions, parse, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def call(**a):
    import json

    return json.dumps({"name": "computer_use", "arguments": a})


def label(spark, student, teacher):
    df = spark.createDataFrame([(student, teacher)], "s array<string>, t array<string>")
    return df.select(actions.classify_calls(parse.decoded_calls(F.col("s")), parse.decoded_calls(F.col("t"))).alias("r")).first().r


def test_parts(spark):
    assert one(spark, "<think>see Action: inner\n</think>\nAction: outer", parse.action_line) == "inner"
    assert one(spark, "before </think> after", parse.thought) == "before"
    assert one(spark, "nothing", parse.thought) is None and one(spark, None, parse.thought) is None
    assert one(spark, "no call", parse.tool_calls) is None
    two = "<tool_call>\n{\"a\": 1}\n</tool_call><tool_call>{broken}</tool_call>"
    assert one(spark, two, parse.tool_calls) == ['{"a": 1}', "{broken}"]
    assert one(spark, two, lambda c: F.size(parse.decoded_calls(parse.tool_calls(c)))) == 1


def test_intent_split(spark):
    f = lambda s: tuple(one(spark, s, parse.intent_split))
    assert f("The menu is open. I'll click on it.\n<tool_call>{}</tool_call>") == ("The menu is open", "I'll click on it.")
    assert f("Let me look") == (None, "Let me look")
    assert f("Nothing to tell") == ("Nothing to tell", None)
    assert f(" <tool_call>{}</tool_call>") == (None, None)
    p = one(spark, "Here it is. Now I will press it.\n<tool_call>{\"name\": 1}</tool_call>", parse.parse_response)
    assert (p.thought, p.action, p.tool) == ("Here it is", "Now I will press it.", ['{"name": 1}'])


def test_classification(spark):
    click = lambda *c: call(action="left_click", coordinate=list(c))
    assert label(spark, [click(100, 100)], [click(120, 80)]) == "exact_match"
    assert label(spark, [click(100, 100)], [click(121, 100)]) == "diff_param"
    assert label(spark, [call(action="middle_click", coordinate=[1, 1])], [call(action="middle_click", coordinate=[900, 1])]) == "exact_match"
    assert label(spark, [call(action="left_click")], [click(1, 1)]) == "diff_param"
    assert label(spark, [call(action="left_click")], [call(action="left_click")]) == "exact_match"
    assert label(spark, [call(action="wait")], [call(action="key", keys=["a"])]) == "action_wait"
    assert label(spark, [call(action="key", keys=["ctrl", "s"]), call(action="wait")], [call(action="key", keys=["ctrl", "s"])]) == "exact_match"
    assert label(spark, [call(action="type", text="a"), call(action="key", keys=["a"])], [call(action="type", text="b"), call(action="scroll", pixels=1)]) == "diff_action"
    assert label(spark, [click(1, 1)], [click(1, 1), click(1, 1)]) == "diff_len"
    assert label(spark, None, [click(1, 1)]) is None and label(spark, [], []) == "action_wait"
    for k, v in {"diff_param": "learn_param", "diff_len": "learn_action", "diff_action": "learn_action", "exact_match": None, "action_wait": None}.items():
        assert one(spark, k, actions.learn_type) == v


def test_judges_texts(spark):
    good = '{"agent_pass": true, "agent_failure_analysis": " x "}'
    v = one(spark, good, text.judge_verdict)
    assert (v.agent_pass, v.failure_analysis, v.parse_error) == (True, "x", False)
    v = one(spark, f"```json\n{good}\n```", text.judge_verdict)
    assert (v.agent_pass, v.failure_analysis, v.parse_error) == (False, None, True)
    assert one(spark, '{"agent_pass": "true"}', text.judge_verdict).agent_pass is None
    assert one(spark, None, text.judge_verdict) is None
    assert one(spark, f"```json\n{good}\n```", text.strip_fence) == good and one(spark, f"```\n{good}", text.strip_fence) == good
    assert one(spark, f"```json\n{good}\n```", text.strip_block_fence) == good and one(spark, f"```json\n{good}", text.strip_block_fence) == f"```json\n{good}"


def test_small_functions(spark):
    assert one(spark, " a\x1c\xa0 b\n", text.normalize_space) == "a b"
    assert one(spark, "seed", text.step_number) == 1 and one(spark, "iter12", text.step_number) == 12 and one(spark, "x", text.step_number) is None
    assert one(spark, " seed, ,iter2 ", text.name_list) == ["seed", "iter2"]
    df = spark.createDataFrame([(2000, 1000), (10, 10), (10**9, 1)], "w long, h long")
    assert [tuple(r.s) for r in df.select(text.scaled_size(F.col("w"), F.col("h")).alias("s")).collect()] == [(1224, 612), (10, 10), (27386127, 1)]
