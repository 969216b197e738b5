"""Runs of (nearly) the same action in trajectories, each collapsed into one event.

Every event is compared with its predecessor by a lag window, changes are
flagged, and their running sum names the runs. The windows go over segments of
``SEGMENT`` lines, so a run of any length is spread over tasks; only the first
and last piece of each segment are joined across segments afterwards.

Defined results: null or blank actions are no events and do not part a run;
rows delivered twice count once (the earliest ``ingested_at`` holds); text that
is no known notation is an event of kind ``other`` compared as text; a run whose
``executed_at`` are all null has a null duration; null task_id or run_no are
values of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = 4096
TOLERANCE = 20

# Names of calls and the kind of action they stand for.
CALLS = {
    "click": "left_click", "doubleclick": "double_click", "rightclick": "right_click", "tripleclick": "triple_click", "middleclick": "middle_click",
    "moveto": "mouse_move", "dragto": "left_click_drag", "typewrite": "type", "write": "type", "press": "key", "hotkey": "key",
    "sleep": "wait", "scroll": "scroll", "terminate": "terminate",
}

_ARGS = "STRUCT<action: STRING, coordinate: ARRAY<DOUBLE>, text: STRING, keys: ARRAY<STRING>, pixels: DOUBLE, time: DOUBLE, status: STRING>"
_CALL = r"(?s)^\s*(?:pyautogui|time)\.(\w+)\s*\((.*)\)\s*;?\s*$"


def _quoted(s: Column) -> Column:
    """The first string literal of ``s`` without its quotes; null when there is none."""
    one, two = F.regexp_extract(s, r"(?s)^[^'\"]*'((?:\\.|[^'\\])*)'", 1), F.regexp_extract(s, r"(?s)^[^'\"]*\"((?:\\.|[^\"\\])*)\"", 1)
    lit = F.when(s.rlike(r"(?s)^[^'\"]*'"), one).when(s.rlike(r"(?s)^[^'\"]*\""), two)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lit, r"\\n", "\n"), r"\\t", "\t"), r"\\(.)", "$1")


def _axis(args: Column, name: str, at: int) -> Column:
    """A coordinate given by name, else by position."""
    number = r"(-?\d+(?:\.\d+)?)"
    named = F.regexp_extract(args, rf"\b{name}\s*=\s*{number}", 1)
    placed = F.regexp_extract(args, (r"^\s*" if at == 0 else r"^\s*-?\d+(?:\.\d+)?\s*,\s*") + number, 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(placed, F.lit(""))).try_cast("double")


def parse_action(action: Column) -> Column:
    """STRUCT<kind, x, y, text, keys, amount, status> of an action in any notation; built-in functions only."""
    j = F.from_json(action, f"STRUCT<name: STRING, arguments: {_ARGS}, action: STRING, coordinate: ARRAY<DOUBLE>, text: STRING, keys: ARRAY<STRING>, pixels: DOUBLE, time: DOUBLE, status: STRING>", {"allowUnquotedControlChars": "true"})
    whole = j["arguments"]["action"].isNotNull()
    arg = lambda f: F.when(whole, j["arguments"][f]).otherwise(j[f])
    is_json = F.coalesce(arg("action").isNotNull(), F.lit(False))
    name, args = F.regexp_extract(action, _CALL, 1), F.regexp_extract(action, _CALL, 2)
    calls = F.create_map(*[F.lit(x) for kv in CALLS.items() for x in kv])
    kind = F.when(is_json, F.lower(F.trim(arg("action")))).otherwise(F.try_element_at(calls, F.lower(name)))
    number = F.regexp_extract(args, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    pointer = kind.isin("left_click", "double_click", "right_click", "triple_click", "middle_click", "mouse_move", "left_click_drag")
    literals = F.transform(F.regexp_extract_all(args, F.lit(r"'[^']*'|\"[^\"]*\""), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"^.|.$", "")))
    return F.struct(
        F.coalesce(kind, F.lit("other")).alias("kind"),
        F.when(is_json, F.get(arg("coordinate"), F.lit(0))).when(pointer, _axis(args, "x", 0)).alias("x"),
        F.when(is_json, F.get(arg("coordinate"), F.lit(1))).when(pointer, _axis(args, "y", 1)).alias("y"),
        F.when(is_json, arg("text")).when(kind == "type", _quoted(args)).when(kind.isNull(), F.trim(action)).alias("text"),
        F.when(is_json, F.transform(arg("keys"), F.lower)).when(kind == "key", literals).alias("keys"),
        F.when(is_json, F.coalesce(arg("pixels"), arg("time"))).when(kind.isin("scroll", "wait"), number).alias("amount"),
        F.lower(F.when(is_json, arg("status")).when(kind == "terminate", _quoted(args))).alias("status"),
    )


def same_action(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """True when two parsed actions are the same; a coordinate that only one of them has makes them differ."""
    near = lambda f: (F.abs(a[f] - b[f]) <= tolerance) | (a[f].isNull() & b[f].isNull())
    equal = lambda f: a[f].eqNullSafe(b[f])
    return F.coalesce(equal("kind") & equal("text") & equal("keys") & equal("amount") & equal("status") & near("x") & near("y"), F.lit(False))


def events(rows: DataFrame) -> DataFrame:
    """(task_id, run_no, line_no, executed_at, act): one parsed event per line; lines delivered twice once."""
    t = rows.select("task_id", "run_no", "line_no", "action", "executed_at", "ingested_at").where("trim(regexp_replace(action, '(?U)\\\\s+', ' ')) <> '' AND line_no IS NOT NULL")
    t = t.groupBy("task_id", "run_no", "line_no").agg(F.min_by(F.struct("action", "executed_at"), F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp"))).alias("r"))
    return t.select("task_id", "run_no", "line_no", F.col("r.executed_at").alias("executed_at"), parse_action(F.col("r.action")).alias("act"))


def _sum_up(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("first_line_no").alias("first_line_no"),
        F.max("last_line_no").alias("last_line_no"),
        F.sum("n_rows").alias("n_rows"),
        F.min("began").alias("began"),
        F.max("ended").alias("ended"),
        F.min_by("head", "first_line_no").alias("head"),
        F.max_by("tail", "last_line_no").alias("tail"),
    )


def collapse_runs(rows: DataFrame, tolerance: float = TOLERANCE, segment: int = SEGMENT) -> DataFrame:
    """One row per run of same events: (task_id, run_no, kind, first_line_no, last_line_no, n_rows, duration_s)."""
    run = ["task_id", "run_no"]
    e = events(rows).withColumn("seg", F.floor(F.col("line_no") / F.lit(segment)))
    w = W.partitionBy(*run, "seg").orderBy("line_no")
    e = e.withColumn("_prev", F.lag("act").over(w))
    e = e.withColumn("_new", F.when(F.col("_prev").isNotNull() & same_action(F.col("_prev"), F.col("act"), tolerance), 0).otherwise(1))
    e = e.withColumn("_piece", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = e.select(*run, "seg", "_piece", F.col("line_no").alias("first_line_no"), F.col("line_no").alias("last_line_no"), F.lit(1).cast("long").alias("n_rows"), F.col("executed_at").alias("began"), F.col("executed_at").alias("ended"), F.col("act").alias("head"), F.col("act").alias("tail"))
    pieces = _sum_up(e, [*run, "seg", "_piece"])
    # Pieces at a segment's edge: the first and the last; all others are whole runs.
    edge = F.max("_piece").over(W.partitionBy(*run, "seg"))
    pieces = pieces.withColumn("_edge", (F.col("_piece") == 1) | (F.col("_piece") == edge))
    # Edges of a run meet, two a segment at most; every other piece is on its own and goes where its segment and number send it.
    pieces = pieces.withColumn("_at", F.when(F.col("_edge"), -1).otherwise(F.col("seg"))).withColumn("_in", F.when(F.col("_edge"), -1).otherwise(F.col("_piece")))
    v = W.partitionBy(*run, "_at", "_in").orderBy("first_line_no")
    before = F.lag(F.struct("seg", "tail")).over(v)
    joined = F.col("_edge") & before.isNotNull() & (before["seg"] != F.col("seg")) & same_action(before["tail"], F.col("head"), tolerance)
    pieces = pieces.withColumn("_start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    pieces = pieces.withColumn("_id", F.sum("_start").over(v.rowsBetween(W.unboundedPreceding, 0)))
    runs = _sum_up(pieces, [*run, "_at", "_in", "_id"])
    return runs.select(*run, F.col("head.kind").alias("kind"), "first_line_no", "last_line_no", "n_rows", ((F.unix_micros("ended") - F.unix_micros("began")) / F.lit(1e6)).alias("duration_s"))
