"""One form of texts."""

import unicodedata

from tracemill.llm.homoglyph import look_classes, lookalike_pairs, mapping, one_form, unify


def test_forms():
    assert one_form("ﬁnal ＡＢ１\xa0x") == "final AB1 x"
    assert one_form("ма​р") == "мap" and one_form("Τοp") == "Top"
    assert one_form("é") == "é" == one_form("é") != one_form("e")
    assert one_form("e​́") == "é" and one_form("ё") == "ë" == one_form("ё")
    assert one_form("a\r\nB") == "a\r\nB" and one_form(None) is None and one_form("") == ""
    assert one_form("A b­c️") == "A bc"


def test_every_form_is_its_own_form():
    for c, p in mapping().items():
        assert one_form(p) == p and one_form(c) == p, hex(ord(c))


def test_plain_way_agrees(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    table = mapping()
    for t in texts:
        want = unicodedata.normalize("NFC", "".join(table.get(x, x) for x in unicodedata.normalize("NFC", "".join(table.get(x, x) for x in t))))
        assert one_form(t) == want and one_form(want) == want


def test_pairs_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {}
    for r in docs.select("doc_id", "text").collect():
        by.setdefault(one_form(r.text), []).append((r.doc_id, r.text))
    want = {(a, b) for v in by.values() for a, s in v for b, t in v if a < b and s != t}
    assert want and {tuple(r) for r in lookalike_pairs(docs).collect()} == want


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "", 0), (4, "abc", 0), (5, "аbc", 0), (6, "abc", 0), (7, "é" * 200000, 0), (8, "é" * 200000, 0), (9, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form int")
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == {(4, 5), (5, 6), (7, 8)}
    assert {r.doc_id: (r.class_id, r.n_spellings) for r in look_classes(df).collect()} == {2: (2, 1), 3: (2, 1), 4: (4, 2), 5: (4, 2), 6: (4, 2), 7: (7, 2), 8: (7, 2)}
    assert lookalike_pairs(df.limit(0)).count() == 0
    assert [r.unified for r in unify(df, "text").orderBy("doc_id").collect()][:5] == [None, "", "", "abc", "abc"]
