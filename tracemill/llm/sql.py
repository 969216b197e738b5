"""SQL that states the results of this subpackage's queries by other means, for comparison."""

from __future__ import annotations

from tracemill.llm.homoglyph import mapping
from tracemill.llm.leaks import _FOLDED, MIN_WORDS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def one_form(c: str) -> str:
    """``c`` in one form: sequences by ``replace``, single characters by ``translate``, accents by ``nfc_normalize``."""
    one = {k: v for k, v in mapping().items() if len(v) == 1}
    none = [k for k, v in mapping().items() if not v]
    out = c
    for k, v in sorted(mapping().items()):
        if len(v) > 1:
            out = f"replace({out}, {_text(k)}, {_text(v)})"
    # characters of the first text without one in the second are taken out
    return f"nfc_normalize(translate({out}, {_text(''.join(one) + ''.join(none))}, {_text(''.join(one.values()))}))"


def folded(c: str) -> str:
    return f"translate(lower(regexp_replace({one_form(c)}, '</?[A-Za-z][^<>\\n]*>', ' ', 'g')), {_text(''.join(map(chr, _FOLDED)))}, {_text(''.join(_FOLDED.values()))})"


def _windows(table: str, key: str, c: str) -> str:
    words = f"list_filter(list_transform(string_split_regex({folded(c)}, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {MIN_WORDS - 1}], ' ') AS p FROM (SELECT {key}, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE {c} IS NOT NULL))"


P3 = r"""
WITH t AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY task_id, run_no, line_no ORDER BY ingested_at NULLS LAST) AS rn FROM trajectory_row WHERE regexp_replace(action, '\s', '', 'g') <> '') WHERE rn = 1),
a AS (SELECT task_id, run_no, line_no, CASE WHEN json_valid(action) THEN coalesce(json_extract(action, '$.arguments'), CAST(action AS JSON)) END AS j,
    lower(regexp_extract(action, '^\s*(?:pyautogui|time)\.(\w+)', 1)) AS f, regexp_extract(action, '(?s)^\s*(?:pyautogui|time)\.\w+\s*\((.*)\)\s*;?\s*$', 1) AS g FROM t),
e AS (SELECT task_id, run_no, line_no,
    CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.action') ELSE CASE f WHEN 'click' THEN 'left_click' WHEN 'doubleclick' THEN 'double_click' WHEN 'rightclick' THEN 'right_click' WHEN 'tripleclick' THEN 'triple_click' WHEN 'moveto' THEN 'mouse_move' WHEN 'typewrite' THEN 'type' WHEN 'write' THEN 'type' WHEN 'press' THEN 'key' WHEN 'hotkey' THEN 'key' WHEN 'sleep' THEN 'wait' ELSE f END END AS kind,
    CASE WHEN j IS NOT NULL THEN CAST(json_extract(j, '$.coordinate[0]') AS DOUBLE) WHEN f LIKE '%click' OR f = 'moveto' THEN CAST(coalesce(nullif(regexp_extract(g, '\bx\s*=\s*(-?[\d.]+)', 1), ''), regexp_extract(g, '^\s*(-?[\d.]+)', 1)) AS DOUBLE) END AS x,
    CASE WHEN j IS NOT NULL THEN CAST(json_extract(j, '$.coordinate[1]') AS DOUBLE) WHEN f LIKE '%click' OR f = 'moveto' THEN CAST(coalesce(nullif(regexp_extract(g, '\by\s*=\s*(-?[\d.]+)', 1), ''), regexp_extract(g, ',\s*(-?[\d.]+)', 1)) AS DOUBLE) END AS y,
    CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.text') WHEN f IN ('typewrite', 'write') THEN regexp_extract(g, '^\s*["''](.*?)["'']', 1) END AS txt,
    CASE WHEN j IS NOT NULL THEN lower(regexp_replace(CAST(json_extract(j, '$.keys') AS VARCHAR), '[\[\]"'' ]', '', 'g')) WHEN f IN ('press', 'hotkey') THEN lower(regexp_replace(g, '["'' ]', '', 'g')) END AS keys,
    CASE WHEN j IS NOT NULL THEN coalesce(CAST(json_extract(j, '$.pixels') AS DOUBLE), CAST(json_extract(j, '$.time') AS DOUBLE)) WHEN f IN ('scroll', 'sleep') THEN CAST(trim(g) AS DOUBLE) END AS amount,
    CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.status') WHEN f = 'terminate' THEN regexp_replace(g, '["'' ]', '', 'g') END AS status FROM a),
n AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(txt) OVER w IS NOT DISTINCT FROM txt AND lag(keys) OVER w IS NOT DISTINCT FROM keys AND lag(amount) OVER w IS NOT DISTINCT FROM amount AND lag(status) OVER w IS NOT DISTINCT FROM status
    AND (abs(lag(x) OVER w - x) <= 20 OR lag(x) OVER w IS NULL AND x IS NULL) AND (abs(lag(y) OVER w - y) <= 20 OR lag(y) OVER w IS NULL AND y IS NULL) THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY task_id, run_no ORDER BY line_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY task_id, run_no ORDER BY line_no) AS r FROM n)
SELECT task_id, run_no, min(line_no) AS first_line_no, max(line_no) AS last_line_no FROM r GROUP BY task_id, run_no, r HAVING count(*) >= 2
"""

P3_RUNS = P3.replace("SELECT task_id, run_no, line_no,\n    CASE WHEN j IS NOT NULL THEN json_extract_string", "SELECT task_id, run_no, line_no, executed_at,\n    CASE WHEN j IS NOT NULL THEN json_extract_string").replace("a AS (SELECT task_id, run_no, line_no,", "a AS (SELECT task_id, run_no, line_no, executed_at,")
P3_RUNS = P3_RUNS[: P3_RUNS.rindex("SELECT task_id")] + "SELECT task_id, run_no, any_value(kind) AS kind, min(line_no) AS first_line_no, max(line_no) AS last_line_no, count(*) AS n_rows, (epoch_us(max(executed_at)) - epoch_us(min(executed_at))) / 1e6 AS duration_s FROM r GROUP BY task_id, run_no, r"

P5 = r"""
WITH RECURSIVE f AS (SELECT sample_id, lower(regexp_replace(regexp_replace(url_decode(unnest(images)), '^\s+|\s+$', '', 'g'), '^.*[/\\]', '')) AS name FROM dpo_sample),
h AS (SELECT 'sample' AS record_type, sample_id AS record_id, '1' || name AS e FROM f WHERE name <> ''
    UNION SELECT 'sample', sample_id, '0' || regexp_extract(name, '^(?:seed|iter\d+)_(.+)_step\d+_input\.png$', 1) FROM f WHERE regexp_matches(name, '^(?:seed|iter\d+)_(.+)_step\d+_input\.png$')
    UNION SELECT 'verify', verify_id, '0' || regexp_replace(regexp_replace(regexp_replace(task_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '^.*/', ''), '\.json$', '') FROM verify_result WHERE task_id IS NOT NULL),
l AS (SELECT record_type, record_id, min(e) AS m FROM h GROUP BY ALL),
edges AS (SELECT DISTINCT h.e AS a, l.m AS b FROM h JOIN l USING (record_type, record_id) WHERE h.e <> l.m),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT m AS node, m AS other FROM l UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
g AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT l.record_type, l.record_id, CASE WHEN starts_with(g.c, '0') THEN substring(g.c, 2) END AS group_task_id FROM l JOIN g ON g.node = l.m
"""

P5_SPLITS = P5.replace("AS group_task_id FROM", """AS group_task_id,
  CASE WHEN ('0x' || left(md5('0/' || g.c), 8))::BIGINT / 4294967296 < 0.8 THEN 'train' WHEN ('0x' || left(md5('0/' || g.c), 8))::BIGINT / 4294967296 < 0.9 THEN 'validation' ELSE 'test' END AS split FROM""")

P8_CLASSES = f"""
WITH d AS (SELECT doc_id, text, {one_form('text')} AS f FROM documents WHERE text IS NOT NULL), c AS (SELECT f, min(doc_id) AS class_id, count(DISTINCT text) AS n_spellings FROM d GROUP BY f)
SELECT d.doc_id, c.class_id, c.n_spellings FROM d JOIN c ON d.f = c.f
"""

P8 = f"""
WITH d AS (SELECT doc_id, text, {one_form('text')} AS f FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text
"""

P6 = f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_windows('documents', 'doc_id', 'text')}) d JOIN ({_windows('eval_item', 'item_id', 'item_text')}) i ON d.p = i.p"

P4 = """
WITH v AS (
  SELECT pool_id, image_id, CAST(embedding AS DOUBLE[64]) AS e FROM image_vector
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT pool_id, image_id FROM v a
WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.pool_id = a.pool_id AND b.image_id < a.image_id AND array_cosine_distance(a.e, b.e) < 0.08)
"""

ORACLE = {"p3_runs": P3_RUNS, "p5_splits": P5_SPLITS, "p8_classes": P8_CLASSES, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p8_found": P8}
