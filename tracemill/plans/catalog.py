"""Registered queries over the project's tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import actions, parse, render, text
from tracemill.operators import dedupe, mining, models, ranks, resume, steps, tasks, vectors, verdicts
from tracemill.session import new_path
from tracemill.sources import files, sinks
from tracemill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "preference_samples"
# Shares of a domain's configurations that its earlier tasks and gaps are sent to.
SHARES = 16

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL where SQL can state it at whole tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# White space as in functions.text.SPACE, spelled out for RE2.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _even(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


# Bare task ids: no folder or domain in front, no file ending.
_BARE = rf"regexp_replace(regexp_replace({_strip('task_id')}, '^.*[/\\]', ''), '(?i)\.jsonl?$', '')"
_KEYED = rf"concat_ws('/', nullif(regexp_extract({_strip('task_id')}, '([^/\\]+)[/\\][^/\\]*$', 1), ''), {_BARE})"


def _verdict_rows(task: str) -> str:
    return f"""v AS (SELECT *, CASE WHEN json_valid(result) THEN result END AS rj FROM (SELECT * EXCLUDE (rn) REPLACE ({task} AS task_id) FROM (
    SELECT *, row_number() OVER (PARTITION BY verify_id ORDER BY judged_at NULLS FIRST) AS rn FROM verify_result) WHERE rn = 1 AND {_BARE} <> ''))"""


_V, _V_KEYED = _verdict_rows(_BARE), _verdict_rows(_KEYED)
_T = """t AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY task_id, run_no, line_no ORDER BY ingested_at NULLS FIRST) AS rn FROM trajectory_row) WHERE rn = 1)"""
_TASKS = "tasks AS (SELECT DISTINCT step, domain, task_id, config_id, instruction, provide_info, config FROM task_config)"
_ANALYSIS = f"""CASE WHEN json_type(rj) = 'OBJECT' THEN coalesce(CASE WHEN json_type(rj, '$.agent_failure_analysis') = 'VARCHAR' THEN {_strip("json_extract_string(rj, '$.agent_failure_analysis')")} END, '') END"""
_WEAK = f"""{_V}, first AS (SELECT step, domain, task_id, agent_pass FROM (
    SELECT *, row_number() OVER (PARTITION BY step, domain, task_id ORDER BY verify_id) AS rn FROM v WHERE agent = 'teacher') WHERE rn = 1),
  weak AS (SELECT s.verify_id, s.step, s.domain, s.task_id, s.instruction, {_ANALYSIS.replace('rj', 's.rj')} AS analysis
    FROM v s JOIN first f ON s.step = f.step AND s.domain = f.domain AND s.task_id = f.task_id WHERE s.agent = 'student' AND s.agent_pass = false AND f.agent_pass)"""
_GATE = f"""{_V_KEYED}, {_TASKS}, last AS (SELECT agent, task_id AS key, agent_pass FROM (
    SELECT *, row_number() OVER (PARTITION BY agent, task_id ORDER BY verify_id DESC) AS rn FROM v) WHERE rn = 1),
  gated AS (SELECT m.step, m.domain, m.task_id FROM (SELECT DISTINCT step, domain, task_id FROM tasks) m
    LEFT JOIN last tl ON tl.agent = 'teacher' AND tl.key = m.domain || '/' || m.task_id LEFT JOIN last ts ON ts.agent = 'teacher' AND ts.key = m.task_id
    LEFT JOIN last sl ON sl.agent = 'student' AND sl.key = m.domain || '/' || m.task_id LEFT JOIN last ss ON ss.agent = 'student' AND ss.key = m.task_id
    WHERE CASE WHEN tl.key IS NOT NULL THEN tl.agent_pass ELSE ts.agent_pass END AND (CASE WHEN sl.key IS NOT NULL THEN sl.agent_pass ELSE ss.agent_pass END) IS NOT TRUE)"""
_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
_SIDES = """sides AS (SELECT sample_id, 'chosen' AS side, chosen.content AS content FROM dpo_sample UNION ALL SELECT sample_id, 'rejected', rejected.content FROM dpo_sample)"""


# The intent's boundary is captured where the engine's pattern looks behind; both leave what follows it.
_INTENT = rf"(?is)(?:^|[.\n]{_WS}*)((?:I''ll|I will|Let me|Now I(?:''ll| will| need to| should| am going to| want to)){_WS}.+)$"


def _parsed(c: str) -> dict[str, str]:
    """SQL of an answer's parts: those of its tags and lines, else those of the intent split."""
    thought = rf"CASE WHEN regexp_matches({c}, '(?s)<think>\s*(.*?)\s*</think>') THEN {_strip(rf"regexp_extract({c}, '(?s)<think>\s*(.*?)\s*</think>', 1)")} WHEN regexp_matches({c}, '(?s)^(.*?)\s*</think>') THEN {_strip(rf"regexp_extract({c}, '(?s)^(.*?)\s*</think>', 1)")} END"
    action = rf"CASE WHEN regexp_matches({c}, 'Action:\s*(.+)') THEN {_strip(rf"regexp_extract({c}, 'Action:\s*(.+)', 1)")} END"
    tool = rf"CASE WHEN len(regexp_extract_all({c}, '{_CALL}', 1)) > 0 THEN regexp_extract_all({c}, '{_CALL}', 1) END"
    words = _strip(rf"regexp_replace({c}, '(?s)<tool_call>.*?</tool_call>', '', 'g')")
    told = f"regexp_extract({words}, '{_INTENT}', 1)"
    lead = f"nullif({_strip(rf"regexp_replace({_strip(f'left({words}, length({words}) - length({told}))')}, '\.+$', '')")}, '')"
    bare = f"({tool}) IS NOT NULL AND ({thought}) IS NULL AND ({action}) IS NULL"
    return {
        "tool": tool,
        "tagged_thought": thought,
        "tagged_action": action,
        "thought": f"CASE WHEN {bare} THEN CASE WHEN regexp_matches({words}, '{_INTENT}') THEN {lead} ELSE nullif({words}, '') END ELSE {thought} END",
        "action": f"CASE WHEN {bare} THEN CASE WHEN regexp_matches({words}, '{_INTENT}') THEN {_strip(told)} END ELSE {action} END",
    }


_LABELS = f"""{_SIDES}, calls AS (SELECT sample_id, side, {_parsed('content')['tool']} AS tool FROM sides),
  used AS (SELECT sample_id, side, row_number() OVER (PARTITION BY sample_id, side ORDER BY pos) AS pos, j, json_extract_string(j, '$.arguments.action') AS act
    FROM (SELECT sample_id, side, unnest(tool) AS j, generate_subscripts(tool, 1) AS pos FROM calls)
    WHERE json_valid(j) AND json_extract_string(j, '$.name') = 'computer_use' AND json_type(j, '$.arguments') = 'OBJECT' AND json_extract_string(j, '$.arguments.action') IS DISTINCT FROM 'wait'),
  n AS (SELECT c.sample_id, bool_and(c.tool IS NOT NULL) AS known, (SELECT count(*) FROM used u WHERE u.sample_id = c.sample_id AND u.side = 'rejected') AS ns, (SELECT count(*) FROM used u WHERE u.sample_id = c.sample_id AND u.side = 'chosen') AS nt FROM calls c GROUP BY c.sample_id),
  zipped AS (SELECT s.sample_id, CASE WHEN s.act IS DISTINCT FROM t.act THEN 'diff_action'
      WHEN s.act IN ('wait', 'terminate', 'scroll') THEN 'exact_match'
      WHEN s.act = 'key' THEN CASE WHEN nullif(CAST(json_extract(s.j, '$.arguments.keys') AS VARCHAR), 'null') IS NOT DISTINCT FROM nullif(CAST(json_extract(t.j, '$.arguments.keys') AS VARCHAR), 'null') THEN 'exact_match' ELSE 'diff_param' END
      WHEN s.act = 'type' THEN CASE WHEN nullif(CAST(json_extract(s.j, '$.arguments.text') AS VARCHAR), 'null') IS NOT DISTINCT FROM nullif(CAST(json_extract(t.j, '$.arguments.text') AS VARCHAR), 'null') THEN 'exact_match' ELSE 'diff_param' END
      WHEN s.act IN ('left_click', 'double_click', 'right_click', 'mouse_move', 'triple_click', 'left_click_drag') THEN
        CASE WHEN json_extract(s.j, '$.arguments.coordinate') IS NULL AND json_extract(t.j, '$.arguments.coordinate') IS NULL
          OR abs(CAST(json_extract(s.j, '$.arguments.coordinate[0]') AS DOUBLE) - CAST(json_extract(t.j, '$.arguments.coordinate[0]') AS DOUBLE)) <= 20 AND abs(CAST(json_extract(s.j, '$.arguments.coordinate[1]') AS DOUBLE) - CAST(json_extract(t.j, '$.arguments.coordinate[1]') AS DOUBLE)) <= 20
        THEN 'exact_match' ELSE 'diff_param' END
      ELSE 'exact_match' END AS label
    FROM used s JOIN used t ON s.sample_id = t.sample_id AND s.pos = t.pos AND s.side = 'rejected' AND t.side = 'chosen'),
  labels AS (SELECT n.sample_id, CASE WHEN NOT known THEN NULL WHEN ns = 0 OR nt = 0 THEN 'action_wait' WHEN ns <> nt THEN 'diff_len'
      WHEN (SELECT bool_and(label = 'exact_match') FROM zipped z WHERE z.sample_id = n.sample_id) THEN 'exact_match'
      WHEN (SELECT bool_or(label = 'diff_action') FROM zipped z WHERE z.sample_id = n.sample_id) THEN 'diff_action' ELSE 'diff_param' END AS label FROM n),
  learned AS (SELECT sample_id, label, CASE WHEN label = 'diff_param' THEN 'learn_param' WHEN label IN ('diff_action', 'diff_len') THEN 'learn_action' END AS learn_type FROM labels)"""


def _delivered_verdicts(s: SparkSession, d: str) -> DataFrame:
    t = verdicts.task_records(dedupe.keep_first(table(s, d, "verify_result"), ["verify_id"], ["judged_at"]))
    return t.where(text.bare_task(F.col("task_id")).isNotNull())


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    """Verdicts under bare ids, without a domain in front or a file ending; deliveries of one row once."""
    return _delivered_verdicts(s, d).withColumn("task_id", text.bare_task(F.col("task_id")))


def _keyed_verdicts(s: SparkSession, d: str) -> DataFrame:
    """As before, with the domain left in front where the id has it, which goes before an id without it."""
    folder = text.non_empty(F.regexp_extract("task_id", r"([^/\\]+)[/\\][^/\\]*$", 1))
    return _delivered_verdicts(s, d).withColumn("task_id", F.concat_ws("/", folder, text.bare_task(F.col("task_id"))))


def _weak(v: DataFrame) -> DataFrame:
    w = verdicts.weakness_pairs(v.where("agent = 'student'"), v.where("agent = 'teacher'"), ["step", "domain", "task_id"], ["verify_id"])
    return w.select("verify_id", "step", "domain", "task_id", "instruction", text.judge_verdict(F.col("result"))["failure_analysis"].alias("analysis"))


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "task_config").select("step", "domain", "task_id", "config_id", "instruction", "provide_info", "config").distinct()


def _gated(s: SparkSession, d: str, v: DataFrame) -> DataFrame:
    return verdicts.gate(_tasks(s, d).select("step", "domain", "task_id").distinct(), v.where("agent = 'teacher'"), v.where("agent = 'student'"), ["verify_id"])


def _lines(s: SparkSession, d: str) -> DataFrame:
    return steps.delivered_once(table(s, d, "trajectory_row"))


def _sides(s: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen.content").alias("content")), F.struct(F.lit("rejected").alias("side"), F.col("rejected.content").alias("content")))
    return table(s, d, "dpo_sample").select("sample_id", F.explode(both).alias("_s")).select("sample_id", "_s.side", "_s.content")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    calls = lambda c: parse.decoded_calls(parse.tool_calls(F.col(f"{c}.content")))
    t = table(s, d, "dpo_sample").withColumn("label", actions.classify_calls(calls("rejected"), calls("chosen")))
    return t.withColumn("learned", actions.learn_type(F.col("label")))


def _joined(c: Column, sep: str = "|") -> Column:
    """An array as text; null items show as ``~``."""
    return F.array_join(c, sep, "~")


@query(f"WITH {_T} SELECT task_id, run_no, count(*) AS n_lines, count(action) AS n_actions, min(line_no) AS first_line, max(line_no) AS last_line FROM t GROUP BY ALL")
def delivered_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines per run, each counted once however often it was delivered."""
    return _lines(s, d).groupBy("task_id", "run_no").agg(F.count("*").alias("n_lines"), F.count("action").alias("n_actions"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


# JSON with a space after commas and colons outside its strings.
_LAID = r"""rtrim(regexp_replace(CAST(json(action) AS VARCHAR), '((?:"(?:[^"\\]|\\.)*"|[^",:])*)([,:]|$)', '\1\2 ', 'g'))"""
_ACTION_TEXT = rf"CASE WHEN action IS NULL THEN '' WHEN json_valid(action) AND regexp_matches(action, '^\s*[\[{{]') THEN {_LAID} ELSE {_strip('action')} END"


@query(rf"""WITH {_T}, f AS (SELECT *, {_ACTION_TEXT} AS act, CASE WHEN row_number() OVER w > 1 AND lag(step_num) OVER w IS NOT DISTINCT FROM step_num THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY task_id, run_no ORDER BY line_no)),
  g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY task_id, run_no ORDER BY line_no) AS BIGINT) AS group_no FROM f)
SELECT task_id, run_no, group_no, coalesce(min(step_num), -1) AS step_num, (list(response ORDER BY line_no))[1] AS response,
  coalesce(string_agg(nullif(act, ''), chr(10) ORDER BY line_no), '') AS action, (list(screenshot_file ORDER BY line_no))[-1] AS screenshot_file, count(*) AS n_lines FROM g GROUP BY ALL""")
def merged_steps(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring lines of one step merged; a step without a number shows -1."""
    return steps.merge_consecutive(_lines(s, d)).na.fill(-1, ["step_num"])


@query(f"""WITH {_T} SELECT task_id, run_no, CAST(coalesce(step_num, 0) AS BIGINT) AS step, (list(response ORDER BY line_no))[1] AS response, string_agg(coalesce(action, '~'), '|' ORDER BY line_no) AS actions, (list(screenshot_file ORDER BY line_no))[-1] AS screenshot_file FROM t GROUP BY ALL""")
def grouped_steps(s: SparkSession, d: str) -> DataFrame:
    """All lines of a step number in one step."""
    return steps.group_by_step(_lines(s, d)).withColumn("actions", _joined(F.col("actions")))


_STEPS = f"""{_T}, s AS (SELECT task_id, run_no, CAST(coalesce(step_num, 0) AS BIGINT) AS step, (list(response ORDER BY line_no))[1] AS response, (list(screenshot_file ORDER BY line_no))[-1] AS screenshot_file FROM t GROUP BY ALL)"""


@query(f"WITH {_STEPS} SELECT task_id, run_no, step, lag(screenshot_file, 1, screenshot_file) OVER (PARTITION BY task_id, run_no ORDER BY step) AS input_screenshot FROM s")
def step_inputs(s: SparkSession, d: str) -> DataFrame:
    """The screenshot each step begins with."""
    return steps.input_screenshot(steps.group_by_step(_lines(s, d))).select("task_id", "run_no", "step", "input_screenshot")


@query(f"WITH {_STEPS} SELECT task_id, run_no, step, coalesce(array_to_string(list(coalesce(response, '')) OVER (PARTITION BY task_id, run_no ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '|'), '') AS history FROM s")
def step_history(s: SparkSession, d: str) -> DataFrame:
    """The last four responses before each step."""
    return steps.history(steps.group_by_step(_lines(s, d)), 4).select("task_id", "run_no", "step", _joined(F.col("history")).alias("history"))


def _instructions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "generated_query").select("domain", text.normalize_space(F.col("instruction")).alias("instruction"), "query_id", "rationale").where("instruction <> ''")


def _dedupe_sql(order: str) -> str:
    return f"SELECT domain, instruction, query_id, rationale FROM (SELECT *, row_number() OVER (PARTITION BY domain, instruction ORDER BY query_id {order}) AS rn FROM (SELECT domain, {_even('instruction')} AS instruction, query_id, rationale FROM generated_query) WHERE instruction <> '') WHERE rn = 1"


@query(_dedupe_sql("ASC"))
def keep_first_instructions(s: SparkSession, d: str) -> DataFrame:
    """Of instructions that are the same but for white space, the first."""
    return dedupe.keep_first(_instructions(s, d), ["domain", "instruction"], ["query_id"])


@query(_dedupe_sql("DESC"))
def keep_last_instructions(s: SparkSession, d: str) -> DataFrame:
    """As before, the last."""
    return dedupe.keep_last(_instructions(s, d), ["domain", "instruction"], ["query_id"])


@query(f"SELECT domain, instruction, min(p) AS pos FROM (SELECT domain, {_even('instruction')} AS instruction, query_id AS p FROM generated_query UNION ALL SELECT domain, {_even('instruction')}, 0 FROM task_config) WHERE instruction <> '' GROUP BY ALL")
def known_instructions(s: SparkSession, d: str) -> DataFrame:
    """Ordered distinct union of the configurations' and the generated instructions."""
    g = table(s, d, "generated_query").select("domain", "instruction", F.col("query_id").alias("pos"))
    t = table(s, d, "task_config").select("domain", "instruction", F.lit(0).cast("bigint").alias("pos"))
    return mining.distinct_instructions(g.unionByName(t), ["domain"], "instruction", "pos")


@query(f"WITH {_SIDES} SELECT sample_id, side, CAST(coalesce(len(tool), -1) AS BIGINT) AS n_calls, CAST(coalesce(len(list_filter(tool, lambda x: json_valid(x))), -1) AS BIGINT) AS n_decoded, array_to_string(tool, '|') AS calls FROM (SELECT sample_id, side, {_parsed('content')['tool']} AS tool FROM sides)")
def tool_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls of each side, raw and decoded; -1 and null where there is none."""
    t = _sides(s, d).withColumn("tool", parse.tool_calls(F.col("content")))
    n = lambda c: F.when(c.isNotNull(), F.size(c).cast("bigint")).otherwise(-1)
    return t.select("sample_id", "side", n(F.col("tool")).alias("n_calls"), n(parse.decoded_calls(F.col("tool"))).alias("n_decoded"), _joined(F.col("tool")).alias("calls"))


@query(f"WITH {_SIDES} SELECT sample_id, side, {_parsed('content')['tagged_thought']} AS thought, {_parsed('content')['tagged_action']} AS action FROM sides")
def thoughts_and_actions(s: SparkSession, d: str) -> DataFrame:
    """Think block and action line of each side."""
    c = F.col("content")
    return _sides(s, d).select("sample_id", "side", parse.thought(c).alias("thought"), parse.action_line(c).alias("action"))


@query(f"WITH {_SIDES} SELECT sample_id, side, {_parsed('content')['thought']} AS thought, {_parsed('content')['action']} AS action, array_to_string({_parsed('content')['tool']}, '|') AS tool FROM sides")
def parsed_responses(s: SparkSession, d: str) -> DataFrame:
    """Each side parsed, with the intent split for answers that have a call alone."""
    return _sides(s, d).withColumn("p", parse.parse_response(F.col("content"))).select("sample_id", "side", "p.thought", "p.action", _joined(F.col("p.tool")).alias("tool"))


@query(f"WITH {_LABELS} SELECT sample_id, label, learn_type FROM learned")
def pair_labels(s: SparkSession, d: str) -> DataFrame:
    """Where the calls of both sides differ and what there is to learn."""
    return _labelled(s, d).select("sample_id", "label", F.col("learned").alias("learn_type"))


@query(f"WITH {_LABELS} SELECT coalesce(learn_type, 'none') AS learn_type, count(*) AS n FROM learned GROUP BY ALL")
def learn_type_counts(s: SparkSession, d: str) -> DataFrame:
    """Pairs by what there is to learn."""
    return _labelled(s, d).groupBy(F.coalesce("learned", F.lit("none")).alias("learn_type")).agg(F.count("*").alias("n"))


@query(f"WITH {_WEAK} SELECT * FROM weak")
def weakness_pairs(s: SparkSession, d: str) -> DataFrame:
    """Student rows that failed where the teacher passed (strict gate)."""
    return _weak(_verdicts(s, d))


@query(f"WITH {_GATE} SELECT * FROM gated")
def preference_gate(s: SparkSession, d: str) -> DataFrame:
    """Tasks the teacher passed and the student did not (loose gate)."""
    return _gated(s, d, _keyed_verdicts(s, d))


@query(f"""WITH {_WEAK}, c AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY verify_id) AS case_no FROM weak)
SELECT domain, case_no, '[Case ' || case_no || ']' || chr(10) || 'task_id: ' || task_id || chr(10) || 'instruction: ' || coalesce(instruction, '') || chr(10) || 'student_failure_analysis: ' || coalesce(analysis, '') AS case_text FROM c""")
def case_texts(s: SparkSession, d: str) -> DataFrame:
    """Numbered cases of the weakness report, a row each."""
    return _cases(_weak(_verdicts(s, d)))


def _cases(weak: DataFrame) -> DataFrame:
    n = ranks.number_rows(weak, ["domain", "verify_id"], "_n")
    first = n.groupBy("domain").agg(F.min("_n").alias("_first"))
    c = n.join(first, "domain").withColumn("case_no", F.col("_n") - F.col("_first") + 1)
    return c.select("domain", "case_no", render.case_text(F.col("case_no"), F.col("task_id"), F.col("instruction"), F.col("analysis")).alias("case_text"))


@query(rf"""WITH {_V} SELECT verify_id, CASE WHEN result IS NULL THEN 'none' WHEN json_type(rj) = 'OBJECT' THEN CASE WHEN json_type(rj, '$.agent_pass') = 'BOOLEAN' THEN json_extract_string(rj, '$.agent_pass') ELSE 'none' END ELSE 'false' END AS agent_pass,
  {_ANALYSIS} AS failure_analysis, coalesce(CAST(CASE WHEN result IS NOT NULL THEN coalesce(json_type(rj), '') <> 'OBJECT' END AS VARCHAR), 'none') AS parse_error,
  {_strip(rf"regexp_replace(regexp_replace({_strip('result')}, '(?i)^```(json)?{_WS}*', ''), '{_WS}*```$', '')")} AS unfenced,
  CASE WHEN len(string_split({_strip('result')}, chr(10))) >= 3 AND starts_with({_strip('result')}, '```') AND {_strip(f"string_split({_strip('result')}, chr(10))[-1]")} = '```' THEN array_to_string(string_split({_strip('result')}, chr(10))[2:-2], chr(10)) ELSE {_strip('result')} END AS unblocked FROM v""")
def judge_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Judges' texts under the three fence policies."""
    j = text.judge_verdict(F.col("result"))
    return _verdicts(s, d).select("verify_id", F.coalesce(j["agent_pass"].cast("string"), F.lit("none")).alias("agent_pass"), j["failure_analysis"].alias("failure_analysis"), F.coalesce(j["parse_error"].cast("string"), F.lit("none")).alias("parse_error"), text.strip_fence(F.col("result")).alias("unfenced"), text.strip_block_fence(F.col("result")).alias("unblocked"))


@query(f"""WITH {_V}, a AS (SELECT verify_id, list_sort(attempt_results) AS a FROM v WHERE len(attempt_results) > 0), f AS (SELECT *, coalesce(list_position(list_transform(a, lambda x: x.agent_pass IS NOT TRUE), true), 0) AS p FROM a)
SELECT verify_id, p = 0 AS agent_pass, CAST(CASE WHEN p > 0 THEN p ELSE len(a) END AS BIGINT) AS num_attempts, a[CASE WHEN p > 0 THEN p ELSE len(a) END].result AS result FROM f""")
def votes(s: SparkSession, d: str) -> DataFrame:
    """The vote over recorded attempts, stopped at the first that does not pass."""
    return _verdicts(s, d).withColumn("v", verdicts.vote(F.col("attempt_results"))).where("v IS NOT NULL").select("verify_id", "v.agent_pass", "v.num_attempts", "v.result")


@query(f"WITH {_V} SELECT agent, step, count(*) AS n, round(avg(CASE WHEN agent_pass THEN 1.0 ELSE 0.0 END), 9) AS mean_score, round(avg(CASE WHEN agent_pass THEN 1.0 ELSE 0.0 END) * 100, 7) AS success_rate FROM v GROUP BY ALL")
def success_rates(s: SparkSession, d: str) -> DataFrame:
    """Share of passes by agent and step; no verdict counts as 0."""
    return verdicts.success_rate(_verdicts(s, d), F.when(F.col("agent_pass"), "1").otherwise("0"), ["agent", "step"])


@query(f"WITH {_V}, {_TASKS} SELECT DISTINCT step, domain, task_id FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.agent = 'student' AND v.agent_pass IS NOT NULL AND v.task_id = t.task_id)")
def unfinished_tasks(s: SparkSession, d: str) -> DataFrame:
    """Tasks without a verdict on the student."""
    done = _verdicts(s, d).where("agent = 'student' AND agent_pass IS NOT NULL")
    return resume.unfinished(_tasks(s, d).select("step", "domain", "task_id").distinct(), done, ["task_id"])


@query(f"WITH {_V}, {_TASKS} SELECT DISTINCT step, domain, task_id, EXISTS (SELECT 1 FROM v WHERE v.error IS NULL AND v.task_id = t.task_id) AS reused FROM tasks t")
def cache_split(s: SparkSession, d: str) -> DataFrame:
    """Tasks and whether a result without an error can be reused."""
    return resume.cache_split(_tasks(s, d).select("step", "domain", "task_id").distinct(), _verdicts(s, d).where("error IS NULL"), ["task_id"])


@query(f"""WITH {_V}, {_TASKS}, w AS (SELECT DISTINCT task_id, agent, part FROM tasks, (VALUES ('student'), ('teacher')) a(agent), (VALUES ('trajectory'), ('verdict')) p(part)),
  have AS (SELECT task_id, agent, 'trajectory' AS part FROM trajectory_row UNION SELECT task_id, agent, 'verdict' FROM v WHERE agent_pass IS NOT NULL)
SELECT task_id, agent, part FROM w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.task_id = w.task_id AND h.agent = w.agent AND h.part = w.part)""")
def missing_results(s: SparkSession, d: str) -> DataFrame:
    """Tasks without a trajectory or a verdict of an agent, and which of the two."""
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(p).alias("part")) for a in ("student", "teacher") for p in ("trajectory", "verdict")]))
    wanted = _tasks(s, d).select("task_id", every.alias("_w")).select("task_id", "_w.agent", "_w.part")
    have = _verdicts(s, d).where("agent_pass IS NOT NULL").select("task_id", "agent", F.lit("verdict").alias("part"))
    have = have.union(table(s, d, "trajectory_row").select("task_id", "agent", F.lit("trajectory").alias("part")))
    return resume.missing(wanted, have, ["task_id", "agent", "part"])


_PATH = r"/home/user(?:/[\w.\-+]+)+(?:\.[a-zA-Z0-9]+)?"
_PATHS = rf"""{_TASKS}, c AS (SELECT step, domain, task_id, config_id, instruction, provide_info, unnest(config) AS c FROM tasks),
  a AS (SELECT *, CASE WHEN json_valid(c.parameters.command) AND json_type(c.parameters.command) = 'ARRAY' THEN from_json(c.parameters.command, '["VARCHAR"]') END AS args FROM c),
  p AS (SELECT step, domain, task_id, config_id, unnest(list_transform(c.parameters.files, lambda f: f.path)) AS path FROM a WHERE c.type = 'download'
    UNION ALL SELECT step, domain, task_id, config_id, unnest(list_filter(args[2:], lambda x: starts_with(x, '/') OR starts_with(x, '~'))) FROM a WHERE c.type = 'launch' AND len(args) >= 2
    UNION ALL SELECT step, domain, task_id, config_id, unnest(regexp_extract_all(array_to_string(args, ' '), '{_PATH}')) FROM a WHERE c.type IN ('command', 'execute')
    UNION ALL SELECT step, domain, task_id, config_id, unnest(regexp_extract_all(array_to_string(provide_info, chr(10)), '{_PATH}')) FROM tasks),
  d AS (SELECT t.step, t.domain, t.task_id, t.instruction, (SELECT string_agg(DISTINCT path, '|' ORDER BY path) FROM p WHERE p.step = t.step AND p.task_id = t.task_id AND p.domain = t.domain AND path <> '') AS paths,
    coalesce((SELECT bool_or(a.c.type = 'launch' AND coalesce(len(a.args), -1) = 1) FROM a WHERE a.step = t.step AND a.task_id = t.task_id AND a.domain = t.domain), false) AS bare_launch,
    coalesce(nullif(array_to_string(list_filter(t.provide_info, lambda x: {_strip('x')} <> ''), chr(10)), ''), '(empty)') AS info FROM tasks t)"""


def _declared(s: SparkSession, d: str) -> DataFrame:
    t = _tasks(s, d)
    return t.select("step", "domain", "task_id", "config_id", "instruction", mining.declared_paths(F.col("config"), F.col("provide_info")).alias("paths"), mining.bare_launch(F.col("config")).alias("bare_launch"), render.info_text(F.col("provide_info")).alias("info"))


@query(f"WITH {_PATHS} SELECT step, domain, task_id, coalesce(paths, '') AS paths, bare_launch, info FROM d")
def declared_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths that tasks declare, whether a program starts bare, and the information given."""
    return _declared(s, d).select("step", "domain", "task_id", _joined(F.col("paths")).alias("paths"), "bare_launch", "info")


_GAPS = """gaps AS (SELECT step, domain, string_agg('task_id: ' || task_id || ': ' || coalesce(analysis, ''), chr(10) ORDER BY verify_id) AS gaps FROM weak GROUP BY ALL)"""


@query(f"""WITH {_PATHS}, {_WEAK}, {_GAPS},
  told AS (SELECT step, domain, {_even('instruction')} AS instruction, min(task_id) AS task_id FROM tasks WHERE {_even('instruction')} <> '' GROUP BY ALL),
  prior AS (SELECT step, domain, string_agg('- ' || instruction, chr(10) ORDER BY n) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY step, domain ORDER BY task_id, instruction) AS n FROM told) GROUP BY ALL),
  modes AS (SELECT step, domain, CAST(NULL AS VARCHAR) AS gaps FROM (SELECT DISTINCT step, domain FROM tasks) UNION ALL SELECT * FROM gaps)
SELECT d.step, d.domain, d.task_id, m.gaps IS NOT NULL AS with_gaps, 'Write 3 new desktop tasks for ' || d.domain || '.' || chr(10)
  || coalesce('Aim at these gaps of the student and name for every task those it aims at in targets_student_gaps:' || chr(10) || m.gaps, 'Cover what earlier tasks leave out.') || chr(10) || chr(10)
  || coalesce('Configuration:' || chr(10) || d.config_id || chr(10) || chr(10), '') || 'Information:' || chr(10) || info || chr(10) || chr(10)
  || CASE WHEN paths IS NOT NULL THEN 'Files in place:' || chr(10) || '- ' || replace(paths, '|', chr(10) || '- ') ELSE 'No file is put in place; a task must not name one.' END || CASE WHEN bare_launch THEN chr(10) || 'A program starts without a file.' ELSE '' END
  || chr(10) || chr(10) || 'Earlier tasks:' || chr(10) || coalesce(p.prior, '(none)') || chr(10) || chr(10) || 'Answer with a JSON object that has a list "queries" of 3 objects with instruction, rationale and reference_config_id.' AS prompt
FROM d JOIN modes m ON m.step = d.step AND m.domain = d.domain LEFT JOIN prior p ON p.step = d.step AND p.domain = d.domain""".replace("SELECT t.step, t.domain, t.task_id, t.instruction,", "SELECT t.step, t.domain, t.task_id, t.config_id, t.instruction,"))
def generation_prompts(s: SparkSession, d: str) -> DataFrame:
    """Prompts for new tasks on the ground of each configuration, with all of the domain's earlier tasks; once more, aimed at all gaps, where the student has any."""
    t, by = _declared(s, d), ["step", "domain"]
    last = lambda c: F.col(c).isNull().alias("last")
    told = mining.distinct_instructions(t, by, "instruction", "task_id").select(*by, F.struct(last("task_id"), "task_id", F.concat(F.lit("- "), "instruction").alias("line")).alias("_p"), F.lit(None).alias("_g"))
    case = render.filled("task_id: {t}: {a}", t=F.col("task_id"), a=F.col("analysis"))
    weak = _weak(_verdicts(s, d)).select(*by, F.lit(None).alias("_p"), F.struct(last("verify_id"), "verify_id", case.alias("line")).alias("_g"))
    lines = lambda c: F.when(F.count(c) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n"))
    texts = told.union(weak).groupBy(*by).agg(lines("_p").alias("prior"), lines("_g").alias("gaps"))
    # texts grow with the domain: they go out once per share of its configurations, never through the driver
    share = F.pmod(F.xxhash64("task_id"), F.lit(SHARES)).cast("int")
    texts = texts.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    c = t.where("step IS NOT NULL AND domain IS NOT NULL").withColumn("_share", share).join(texts.hint("shuffle_hash"), [*by, "_share"], "left")
    c = c.withColumn("with_gaps", F.explode(F.when(F.col("gaps").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    w = render.workspace_text(F.col("paths"), F.col("bare_launch"))
    p = render.generation_prompt(F.col("domain"), F.col("info"), w, F.col("prior"), F.when(F.col("with_gaps"), F.col("gaps")), F.col("config_id"))
    return c.select("step", "domain", "task_id", "with_gaps", p.alias("prompt"))


@query("SELECT query_id, coalesce(nullif(reference_config_id, ''), nullif(config_id, '')) AS config_id FROM generated_query WHERE coalesce(nullif(reference_config_id, ''), nullif(config_id, '')) IS NOT NULL")
def fallback_ids(s: SparkSession, d: str) -> DataFrame:
    """The configuration a query refers to, else its block's."""
    return table(s, d, "generated_query").select("query_id", tasks.config_id(F.col("reference_config_id"), F.col("config_id")).alias("config_id")).where("config_id IS NOT NULL")


@query("SELECT query_id, 'task' || row_number() OVER (ORDER BY query_id) AS task_id, domain, instruction FROM generated_query WHERE instruction <> ''")
def numbered_tasks(s: SparkSession, d: str) -> DataFrame:
    """Tasks numbered over all queries that have an instruction."""
    return tasks.numbered_tasks(table(s, d, "generated_query"), ["query_id"]).select("query_id", "task_id", "domain", "instruction")


@query("SELECT query_id, 0 AS pos, instruction FROM generated_query WHERE trim(instruction) <> '' UNION ALL SELECT query_id, 1, rationale FROM generated_query WHERE trim(rationale) <> '' UNION ALL SELECT query_id, 2, config_file FROM generated_query WHERE trim(config_file) <> ''")
def document_instructions(s: SparkSession, d: str) -> DataFrame:
    """Instructions found in documents of all three shapes."""
    q = lambda c: F.struct(F.array(F.struct(F.col(c).alias("instruction"))).alias("queries"))
    doc = F.to_json(F.struct("instruction", q("rationale").alias("parsed"), F.array(F.struct(q("config_file").alias("parsed"))).alias("per_config")), {"ignoreNullFields": "false"})
    return mining.document_instructions(table(s, d, "generated_query").select("query_id", doc.alias("doc")), ["query_id"], "doc")


@query(f"WITH {_TASKS} SELECT step, domain, CAST((row_number() OVER (PARTITION BY step, domain ORDER BY task_id) - 1) // 10000 AS BIGINT) AS chunk, task_id FROM (SELECT DISTINCT step, domain, task_id FROM tasks)".replace("SELECT step, domain, CAST", "SELECT step, domain, chunk, string_agg(task_id, '|' ORDER BY task_id) AS task_ids FROM (SELECT step, domain, CAST", 1) + ") GROUP BY ALL")
def manifests(s: SparkSession, d: str) -> DataFrame:
    """Task ids per step and domain, in chunks."""
    m = tasks.manifest(_tasks(s, d).select("step", "domain", "task_id").distinct(), ["step", "domain"])
    return m.select("step", "domain", "chunk", _joined(F.col("task_ids")).alias("task_ids"))


@query("SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY task_id) - 1 AS INTEGER) AS pos, task_id FROM (SELECT DISTINCT domain, task_id FROM task_config)")
def manifest_tasks(s: SparkSession, d: str) -> DataFrame:
    """Manifests written as documents and read back as rows."""
    m = tasks.manifest(table(s, d, "task_config").select("domain", "task_id").distinct(), ["domain"])
    docs = m.select("chunk", F.to_json(F.create_map("domain", "task_ids")).alias("doc"))
    rows = tasks.manifest_rows(docs.withColumn("doc", F.col("doc")), "doc")
    return rows


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def registry_upsert(s: SparkSession, d: str) -> DataFrame:
    """Entries of a registry put in place of those of the same key."""
    n = table(s, d, "nation")
    new = n.where("n_regionkey = 1").withColumn("n_name", F.lower("n_name"))
    return tasks.upsert(n, new, "n_nationkey").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS BIGINT) AS shard FROM documents")
def balanced_shards(s: SparkSession, d: str) -> DataFrame:
    """Documents in seven contiguous shards."""
    return ranks.balanced_shards(table(s, d, "documents").select("doc_id"), ["doc_id"], 7)


_X = "x AS (SELECT pool_id, image_id, CAST(embedding AS DOUBLE[64]) AS e FROM image_vector WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


@query(f"""WITH {_X}, p AS (SELECT a.pool_id, a.image_id, CASE WHEN b.image_id IS NOT NULL THEN array_cosine_distance(a.e, b.e) END AS dist FROM x a LEFT JOIN x b ON a.pool_id = b.pool_id AND a.image_id <> b.image_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY pool_id, image_id ORDER BY dist) AS rn FROM p) SELECT pool_id, image_id, round(coalesce(avg(dist), 0), 6) + 0.0 AS uniqueness FROM r WHERE rn <= 20 GROUP BY ALL""")
def neighbour_uniqueness(s: SparkSession, d: str) -> DataFrame:
    """Mean distance of each image to the twenty nearest of its pool."""
    return vectors.neighbour_uniqueness(table(s, d, "image_vector"), "pool_id", "image_id", "embedding").withColumn("uniqueness", F.round("uniqueness", 6) + F.lit(0.0))


@query()
def diverse_images(s: SparkSession, d: str) -> DataFrame:
    """``top_n`` farthest images of each pool, by uniqueness."""
    n = table(s, d, "selection_result").select("pool_id", F.col("top_n").cast("bigint").alias("n"))
    return vectors.diverse_samples(table(s, d, "image_vector"), n, "pool_id", "image_id", "embedding").withColumn("uniqueness", F.round("uniqueness", 6))


@query(r"""SELECT pool_id, row_number() OVER (PARTITION BY pool_id ORDER BY ord) AS pos, index FROM (
  SELECT pool_id, index, min(ord) AS ord FROM (SELECT pool_id, num_total_images AS total, CAST(regexp_extract(unnest(selected_paths), 'shot_(\d+)', 1) AS BIGINT) AS index, generate_subscripts(selected_paths, 1) AS ord FROM selection_result) WHERE index >= 0 AND index < total GROUP BY ALL)""")
def valid_selections(s: SparkSession, d: str) -> DataFrame:
    """Chosen screenshot numbers in range, each once."""
    t = table(s, d, "selection_result").withColumn("indices", F.transform("selected_paths", lambda p: F.regexp_extract(p, r"shot_(\d+)", 1).try_cast("bigint")))
    return vectors.valid_indices(t, ["pool_id"], "indices", "num_total_images")


_USER = "'<image>' || chr(10) || 'Look at the screenshot, the instruction and the earlier moves, then give the next move.' || chr(10) || chr(10) || 'Instruction: ' || coalesce(g.instruction, '') || chr(10) || chr(10) || 'Previous actions:' || chr(10) || 'None'"


def _content(c: str) -> str:
    p = _parsed(c)
    return f"'<think>' || coalesce({p['thought']}, '') || chr(10) || '</think>' || chr(10) || chr(10) || 'Action: ' || coalesce({p['action']}, '') || chr(10) || coalesce(array_to_string(list_transform({p['tool']}, lambda x: '<tool_call>' || chr(10) || x || chr(10) || '</tool_call>'), chr(10)), '')"


def _paired(s: SparkSession, d: str) -> DataFrame:
    """Samples with something to learn, the first image that names a task, however its path is spelled, and that task in lower case."""
    task = lambda p: text.task_of_file(text.file_name(p))
    t = _labelled(s, d).where("learned IS NOT NULL").withColumn("image", F.get(F.filter("images", lambda p: task(p).isNotNull()), F.lit(0)))
    return t.withColumn("task_id", task(F.col("image")))


def _rendered(pairs: DataFrame, gated: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pairs of gated tasks, as prompt and answers; the pairs' tasks are in lower case."""
    g = gated.join(tasks, ["step", "domain", "task_id"]).groupBy("step", "task_id").agg(F.min("instruction").alias("instruction"))
    t = pairs.withColumnRenamed("task_id", "_named").join(g, F.col("_named") == F.lower("task_id"))
    for c in ("chosen", "rejected"):
        t = t.withColumn(f"_{c}", parse.parse_response(F.col(f"{c}.content")))
    t = t.withColumn("r", render.preference_sample(F.col("instruction"), F.col("image"), F.col("_chosen"), F.col("_rejected"), F.col("learned")))
    return t.select("sample_id", "task_id", F.col("r.learn_type").alias("learn_type"), F.col("r.conversations")[1]["content"].alias("prompt"), F.col("r.chosen.content").alias("chosen"), F.col("r.rejected.content").alias("rejected"), F.col("r.images")[0].alias("image"))


_FILE = r"lower(regexp_replace(regexp_replace(url_decode(p), '^\s+|\s+$', '', 'g'), '^.*[/\\]', ''))"
_NAMED = r"'^(?:seed|iter\d+)_(.+)_step\d+_input\.png$'"


@query(rf"""WITH {_GATE}, {_LABELS.replace('n AS (', 'cnt AS (').replace('FROM n)', 'FROM cnt)').replace('n.sample_id', 'cnt.sample_id')},
  paths AS (SELECT sample_id, unnest(images) AS p, generate_subscripts(images, 1) AS pos FROM dpo_sample),
  first_named AS (SELECT sample_id, arg_min(p, pos) AS image, arg_min(regexp_extract({_FILE}, {_NAMED}, 1), pos) AS named FROM paths WHERE regexp_matches({_FILE}, {_NAMED}) GROUP BY ALL),
  inst AS (SELECT g.step, g.task_id, min(t.instruction) AS instruction FROM gated g JOIN tasks t ON t.step = g.step AND t.domain = g.domain AND t.task_id = g.task_id GROUP BY ALL)
SELECT d.sample_id, g.task_id, l.learn_type, {_USER} AS prompt, {_content('d.chosen.content')} AS chosen, {_content('d.rejected.content')} AS rejected, n.image
FROM dpo_sample d JOIN first_named n ON n.sample_id = d.sample_id JOIN inst g ON lower(g.task_id) = n.named JOIN learned l ON l.sample_id = d.sample_id WHERE l.learn_type IS NOT NULL""")
def preference_samples(s: SparkSession, d: str) -> DataFrame:
    """Preference samples end to end: gated tasks, parsed and compared sides, rendered prompt and answers; answers without tag and action line are parted by their intent."""
    return _rendered(_paired(s, d), _gated(s, d, _keyed_verdicts(s, d)), _tasks(s, d))


# Tables written as the files that runs leave, and read back.
@query(f"""WITH {_TASKS} SELECT step || '_' || domain || '_' || task_id AS task_id, instruction, array_to_string(provide_info, '|') AS info, CAST(len(config) AS BIGINT) AS n_steps, array_to_string(list_transform(config, lambda c: coalesce(c.type, '~')), '|') AS types FROM tasks""")
def task_files(s: SparkSession, d: str) -> DataFrame:
    """Tasks written as a document each and read as configurations; the file's stem is the id."""
    folder = new_path(s, "task-files")
    t = _tasks(s, d).select(F.concat_ws("_", "step", "domain", "task_id").alias("name"), F.to_json(F.struct(F.lit("x").alias("id"), "config_id", "instruction", "provide_info", "config")).alias("doc"))
    sinks.write_per_task(t, folder, "name", "doc")
    return files.task_configs(s, folder).select("task_id", "instruction", _joined(F.col("provide_info")).alias("info"), F.size("config").cast("bigint").alias("n_steps"), _joined(F.transform("config", lambda c: c["type"])).alias("types"))


@query("""SELECT l AS json, count(*) AS n FROM (SELECT regexp_replace(action, '[\r\n]', ' ', 'g') AS l FROM trajectory_row WHERE action IS NOT NULL) WHERE json_valid(l) AND regexp_matches(l, '\\S') GROUP BY l""")
def action_lines(s: SparkSession, d: str) -> DataFrame:
    """Actions written as lines and read permissively: only those that are JSON are left."""
    folder = new_path(s, "action-lines")
    table(s, d, "trajectory_row").where("action IS NOT NULL").select(F.regexp_replace("action", r"[\r\n]", " ").alias("value")).write.text(folder)
    return files.json_lines(s, folder, strict=False).groupBy("json").agg(F.count("*").alias("n"))


@query(f"""SELECT verify_id, {_strip('task_id')} AS task_id, agent_pass, error, CAST(coalesce(len(attempt_results), -1) AS BIGINT) AS n_attempts FROM (SELECT *, row_number() OVER (PARTITION BY verify_id ORDER BY judged_at NULLS FIRST) AS rn FROM verify_result) WHERE rn = 1 AND {_strip('task_id')} <> ''""")
def verdict_files(s: SparkSession, d: str) -> DataFrame:
    """Verdicts written as a list document per step, domain and agent and read as typed rows; the id travels as the trajectory's path."""
    folder, by = new_path(s, "verdict-files"), ["step", "domain", "agent"]
    v = dedupe.keep_first(table(s, d, "verify_result"), ["verify_id"], ["judged_at"]).withColumn("traj_path", F.col("verify_id").cast("string"))
    kept = F.to_json(F.struct("task_id", "traj_path", "agent_pass", "attempt_results", "error"))
    part = F.floor(F.col("verify_id") / 10_000).alias("part")  # a document's list does not grow with the table
    docs = v.groupBy(*by, part).agg(F.concat(F.lit("["), F.array_join(F.collect_list(kept), ","), F.lit("]")).alias("doc"))
    sinks.write_per_task(docs.select(F.md5(F.concat_ws("/", *by, F.col("part").cast("string"))).alias("name"), "doc"), folder, "name", "doc")
    t = verdicts.task_records(files.verify_results(s, folder))
    return t.select(F.col("traj_path").cast("bigint").alias("verify_id"), "task_id", "agent_pass", "error", F.coalesce(F.size("attempt_results"), F.lit(-1)).cast("bigint").alias("n_attempts"))


@query(rf"""WITH {_GATE} SELECT g.step, g.domain, g.task_id, CAST(count(DISTINCT t.run_no) AS BIGINT) AS n_runs FROM gated g JOIN trajectory_row t ON t.task_id = g.task_id AND t.agent = 'teacher' GROUP BY ALL""")
def replayed_runs(s: SparkSession, d: str) -> DataFrame:
    """Teacher's runs of gated tasks that a student is to be replayed on."""
    runs = table(s, d, "trajectory_row").where("agent = 'teacher'").select("task_id", "run_no").distinct()
    return _gated(s, d, _keyed_verdicts(s, d)).join(runs, "task_id").groupBy("step", "domain", "task_id").agg(F.count("*").alias("n_runs"))


@query(f"""WITH {_STEPS}, h AS (SELECT *, row_number() OVER w AS rn, lag(coalesce(response, '')) OVER w AS before, lag(screenshot_file, 1, screenshot_file) OVER w AS seen FROM s WINDOW w AS (PARTITION BY task_id, run_no ORDER BY step))
SELECT task_id, run_no, step, response AS teacher_response, CASE WHEN rn = 1 THEN 'first' ELSE 'after ' || before END AS student_response, coalesce(seen, 'none') AS student_action FROM h""")
def forced_replay(s: SparkSession, d: str) -> DataFrame:
    """A student that tells what it sees, replayed on all runs: it sees the teacher's answers, never its own."""
    g = steps.input_screenshot(steps.group_by_step(_lines(s, d)))
    told = lambda turns, now: ("after " + turns[-1]["response"] if turns else "first", now["screenshot"] or "none")
    return models.forced_replay(g, told, 1)


@query(f"""WITH {_V} SELECT verify_id, CASE WHEN result IS NULL THEN NULL WHEN json_type(rj) = 'OBJECT' THEN CASE WHEN json_type(rj, '$.agent_pass') = 'BOOLEAN' THEN CAST(json_extract_string(rj, '$.agent_pass') AS BOOLEAN) ELSE false END ELSE false END AS agent_pass,
  CASE WHEN result IS NULL THEN 'no recorded answer' END AS error FROM v""")
def judged_prompts(s: SparkSession, d: str) -> DataFrame:
    """Verdicts by the path of a judge's call: a prompt a row, its recorded answer by the prompt's hash, the vote; rows without an answer are errors."""
    v = _verdicts(s, d).select("verify_id", "result", F.concat_ws("\n", F.col("verify_id").cast("string"), render.judge_prompt(F.col("instruction"), F.array().cast("array<struct<step_num: bigint, response: string, action: string, screenshot_file: string>>"))).alias("prompt"))
    answers = v.where("result IS NOT NULL").select(F.lit("judge").alias("stage"), F.sha2("prompt", 256).alias("prompt_sha"), F.lit(1).alias("attempt"), F.col("result").alias("output_text"), F.lit(None).cast("string").alias("error"))
    return models.judged(models.recorded(v.select("verify_id", "prompt"), answers, "judge"), ["verify_id"]).select("verify_id", "agent_pass", "error")
