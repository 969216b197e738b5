"""Parts of an agent's answer: calls, action line and thought."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import non_empty, strip

# The patterns of an answer's parts.
CALL = r"(?sU)<tool_call>\s*(\{.*?\})\s*</tool_call>"
ACTION = r"(?dU)Action:\s*(.+)"
THOUGHT = r"(?sU)<think>\s*(.*?)\s*</think>"
OPEN_THOUGHT = r"(?sU)^(.*?)\s*</think>"
INTENT = r"(?isuU)(?:(?<=\.)\s*|(?<=\n)\s*|^)((?:I'll|I will|Let me|Now I(?:'ll| will| need to| should| am going to| want to))\s.+)$"


def _first(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def tool_calls(c: Column) -> Column:
    """Raw JSON of the calls; null (not empty) when there are none."""
    a = F.regexp_extract_all(c, F.lit(CALL), F.lit(1))
    return F.when(F.size(a) > 0, a)


def decoded_calls(calls: Column) -> Column:
    """ARRAY<STRUCT<name, arguments>> of the calls that are JSON; others are dropped. ``keys`` and ``text`` keep their type, as variants."""
    # Verified edge: from_json turns broken text into a struct of nulls, so broken calls are filtered first.
    schema = "STRUCT<name: STRING, arguments: STRUCT<action: STRING, keys: VARIANT, text: VARIANT, coordinate: ARRAY<DOUBLE>, pixels: DOUBLE, time: DOUBLE, status: STRING>>"
    return F.transform(F.filter(calls, lambda x: F.try_parse_json(x).isNotNull()), lambda x: F.from_json(x, schema))


def action_line(c: Column) -> Column:
    """What follows the first ``Action:``, to the end of its line; null when there is none."""
    return _first(c, ACTION)


def thought(c: Column) -> Column:
    """The think block, else all before a closing think tag; null when there is neither."""
    return F.coalesce(_first(c, THOUGHT), _first(c, OPEN_THOUGHT))


def intent_split(c: Column) -> Column:
    """STRUCT<thought, action>: text without calls, parted where a sentence tells an intent; both null for empty text."""
    t = strip(F.regexp_replace(c, r"(?sU)<tool_call>.*?</tool_call>", ""))
    found = t.rlike(INTENT)
    act = F.regexp_extract(t, INTENT, 1)
    # The intent runs to the end of the text, so what precedes it is known by length.
    before = F.substring(t, F.lit(1), F.length(t) - F.length(act))
    lead = non_empty(strip(F.regexp_replace(strip(before), r"\.+$", "")))
    out = F.when(found, F.struct(lead.alias("thought"), strip(act).alias("action"))).otherwise(F.struct(t.alias("thought"), F.lit(None).cast("string").alias("action")))
    return F.when(t != "", out).otherwise(F.struct(F.lit(None).cast("string").alias("thought"), F.lit(None).cast("string").alias("action")))


def parse_response(c: Column) -> Column:
    """STRUCT<response, thought, action, tool>; the intent split is used only for answers with a call and neither tag nor action line."""
    tool, th, act = tool_calls(c), thought(c), action_line(c)
    bare = tool.isNotNull() & th.isNull() & act.isNull()
    split = intent_split(c)
    return F.struct(c.alias("response"), F.when(bare, split["thought"]).otherwise(th).alias("thought"), F.when(bare, split["action"]).otherwise(act).alias("action"), tool.alias("tool"))
