"""Defects of preference pairs: the classifier on answers of its own making, held out, and edges."""

import random

import pytest

from tracemill.llm.defects import KINDS, Model, _broken, copies, features, find_defects, is_empty, language_shares, learn, prose, sides, stops_early, train

D = "/root/testdata/sf0.1/dpo_sample.parquet"


def test_parts():
    call = '<tool_call>\n{"name": "computer_use", "arguments": {"action": "left_click", "coordinate": [1, 2]}}\n</tool_call>'
    wait = '<tool_call>\n{"name": "computer_use", "arguments": {"action": "wait", "time": 1}}\n</tool_call>'
    assert not stops_early("a\n" + call) and stops_early("a\n" + call[:-3]) and stops_early("a") and stops_early(call + "\n<tool_call>\n{")
    assert is_empty(None) and is_empty(" ​\xa0") and is_empty("<think>\n</think>\n\nAction: \n") and is_empty("N/A") and not is_empty("No.") and not is_empty(call)
    assert copies("Instruction: Do it now", "do IT!\n" + wait) and not copies("Instruction: Do it now", "do it\n" + call)
    assert max(language_shares("Pulsa la tecla y espera"), key=language_shares("Pulsa la tecla y espera").get) == "es"
    assert language_shares('file_1.txt "Schließen"') == {}


def test_held_out_accuracy(spark):
    """Trained on a sample, applied to defects made from other rows."""
    t = spark.read.parquet(D)
    model = learn(t)
    rng = random.Random(99)
    rows = [(r.user, r.content) for r in sides(t).where("content IS NOT NULL AND pmod(sample_id, 9) = 4").collect()]
    sound = [(u, c) for u, c in rows if not is_empty(c) and not stops_early(c) and not copies(u, c)]
    others = [(u, language_shares(prose(c)), c) for u, c in sound]
    right, made = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for u, c in sound[:300]:
        for k in KINDS:
            if (b := _broken(rng, k, u, c, others, {})) is not None:
                made[k] += 1
                right[k] += model.defect(u, b, model.scores([features(u, b)])[0]) == k
    assert all(right[k] >= 0.97 * made[k] and made[k] > 100 for k in KINDS), (right, made)
    flagged = sum(model.defect(u, c, model.scores([features(u, c)])[0]) is not None for u, c in sound)
    assert flagged < 0.05 * len(sound)
    # reports that the screen makes it impossible, and declining something else, are no refusals
    asked = "<image>\nInstruction: Open the picture in GIMP and rotate it by 3 degrees.\n\nPrevious actions:\nNone"
    for a in ("The search box is greyed out in this build and the file it needs does not exist.", "I must decline the update offer before anything else becomes usable."):
        c = f'<think>{a}\n</think>\n\nAction: Click on the folder tree\n<tool_call>\n{{"name": "computer_use", "arguments": {{"action": "left_click", "coordinate": [1, 2]}}}}\n</tool_call>'
        assert model.defect(asked, c, model.scores([features(asked, c)])[0]) is None


# Words of refusals in the table that training is to do without, for two tests of what it has never seen.
FAMILIES = [["with this request", "over a line", "off limits", "AI model", "role ends", "rather not take"], ["guidelines do not", "choose not to act", "somebody else", "must decline to do", "not permitted to assist", "beyond what"]]


@pytest.mark.parametrize("family", FAMILIES)
def test_refusals_of_families_left_out_of_training(spark, family):
    rows = [(r.user, r.content, any(x in r.content for x in family)) for r in sides(spark.read.parquet(D)).where("content IS NOT NULL").orderBy("sample_id", "side").collect()]
    rest = [(u, c) for u, c, is_ in rows if not is_ and not is_empty(c)]
    random.Random(5).shuffle(rest)
    model = train(rest[:1000], [(u, c) for u, c in rest if "</tool_call>" not in c][:1000])
    held = [(u, c) for u, c, is_ in rows if is_]
    found = sum(model.defect(u, c, model.scores([features(u, c)])[0]) == "refusal" for u, c in held)
    assert len(held) > 25 and found >= 0.9 * len(held), (found, len(held))


def test_edges(spark, tmp_path):
    schema = "sample_id long, conversations array<struct<role:string,content:string>>, chosen struct<role:string,content:string>, rejected struct<role:string,content:string>, learn_type string, side string"
    user = [("user", "<image>\nInstruction: Open a_1.txt and save it.\n\nPrevious actions:\nNone")]
    rows = [(1, None, None, ("assistant", None), None, "x"), (2, user, ("assistant", ""), ("assistant", "Open a_1.txt and save it."), None, "x"), (2, user, ("assistant", ""), ("assistant", "Open a_1.txt and save it."), None, "x"), (3, user, ("assistant", "I see the menu now " * 20000), ("assistant", "null"), "z", "x"), (None, user, None, None, None, None), (4, [None, ("user", None)], ("a", "b"), None, None, None)]
    model = learn(spark.read.parquet("/root/testdata/sf0.01/dpo_sample.parquet"))
    model.save(spark, f"file://{tmp_path}/model")
    model = Model.load(spark, f"file://{tmp_path}/model")
    got = {(r.sample_id, r.side, r.defect_type) for r in find_defects(spark.createDataFrame(rows, schema), model).collect()}
    assert {x for x in got if x[0] < 3} == {(1, "chosen", "empty"), (1, "rejected", "empty"), (2, "chosen", "empty"), (2, "rejected", "copies_prompt")}
    assert (3, "rejected", "empty") in got and (4, "rejected", "empty") in got
    assert find_defects(spark.createDataFrame([], schema)).count() == 0
