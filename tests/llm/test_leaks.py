"""Leak search against brute force."""

import random
import re
import unicodedata

import pytest

from tracemill.llm.leaks import Items, doc_words, find_leaks, fold, myers


def distance_inside(p, t):
    """Least edit distance of p to any part of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        before, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_against_table():
    rng = random.Random(5)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert myers(p, t, 200) == distance_inside(p, t)


def test_every_single_edit_is_found():
    rng = random.Random(2)
    vocabulary = ["the", "grader", "wants", "page-count", "on", "a", "mixed", "playlist", "whenever", "some", "baker", "9922", "plus", "one"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(50))) for i in range(20)]
    known = Items(texts, 12, 1)
    for _ in range(1500):
        key, t = rng.choice(texts)
        w = t.split()
        at = rng.randrange(len(w) - 11)
        p = " ".join(w[at : at + 12])
        j = rng.randrange(len(p))
        q = rng.choice([p[:j] + p[j + 1 :], p[:j] + "z" + p[j:], p[:j] + "z" + p[j + 1 :]])
        assert key in {k for k, _, _ in known.search(f"alpha beta {q} gamma delta")}


def brute(docs, items):
    def w(t):
        return [x for x in (re.sub(r"[\W_]+", "", p) for p in fold(t).split()) if x]

    out = set()
    for d, t in docs:
        joined = "\n" + "\n".join(w(t)) + "\n"
        for i, s in items:
            ws = w(s)
            if any("\n" + "\n".join(ws[k : k + 12]) + "\n" in joined for k in range(len(ws) - 11)):
                out.add((d, i))
    return out


def test_small_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_item.parquet")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).where("edits = 0").collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect() if r.text], [(r.item_id, r.item_text) for r in items.collect() if r.item_text])
    again = {(r.doc_id, r.item_id) for r in find_leaks(docs, items, block_bytes=9000).where("edits = 0").collect()}
    assert again == got


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "too short")], "item_id long, item_text string")
    rows = [(1, None), (2, ""), (3, passage.upper().replace(" ", " **\n")), (4, "one two three four five six seven eight nine ten eleven"), (5, "x " * 200000 + passage), (6, passage.replace("o", "о").replace("e", "e​")), (6, passage), (7, passage.replace("seven", "sevan"))]
    got = {(r.doc_id, r.item_id, r.edits, r.matched_words) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(3, 1, 0, 12), (5, 1, 0, 12), (6, 1, 0, 12), (7, 1, 1, 12)}
    assert find_leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    assert find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).count() == 0
