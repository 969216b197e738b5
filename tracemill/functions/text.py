"""Text and JSON column functions. Null in, null out unless a function says otherwise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.split sees it; Java's (?U)\s lacks U+001C..U+001F.
SPACE = r"[\s\x{1c}-\x{1f}]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?U){SPACE}+", " "), "^ | $", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_empty(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))


def strip_fence(c: Column) -> Column:
    """Fence policy A: an opening fence (with or without ``json``) and a closing one go, each on its own."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), rf"(?Ui)^```(?:json)?{SPACE}*", ""), rf"(?U){SPACE}*```$", ""))


def strip_block_fence(c: Column) -> Column:
    """Fence policy B: only whole blocks of three lines or more whose last line is the bare fence."""
    lines = F.split(strip(c), "\n")
    n = F.size(lines)
    whole = (n >= 3) & F.get(lines, F.lit(0)).startswith("```") & (strip(F.get(lines, n - 1)) == "```")
    return F.when(whole, F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n")).otherwise(strip(c))


def json_object(c: Column) -> Column:
    """The text when it is a JSON object, else null (fence policy C: fences are not taken off)."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), c)


def json_boolean(c: Column, name: str) -> Column:
    """A member that is true or false; other types, ``"true"`` among them, go to null."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean"))


def json_text(c: Column, name: str) -> Column:
    """A member that is a text; other types go to null."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def json_has(c: Column, name: str) -> Column:
    """Whether a JSON object has the member, be it null."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), name), F.lit(False))


def judge_verdict(c: Column) -> Column:
    """STRUCT<agent_pass, failure_analysis, parse_error>: text that is no JSON does not pass and is kept as an error."""
    ok = json_object(c).isNotNull()
    return F.when(c.isNotNull(), F.struct(F.when(ok, json_boolean(c, "agent_pass")).otherwise(F.lit(False)).alias("agent_pass"), F.when(ok, strip(F.coalesce(json_text(c, "agent_failure_analysis"), F.lit("")))).alias("failure_analysis"), (~ok).alias("parse_error")))


def _spaced(s: str | None) -> str | None:
    """JSON with a space after commas and colons; other text stripped."""
    if s is None:
        return ""
    t = s.strip()
    if t[:1] in "{[":
        try:
            return json.dumps(json.loads(t), ensure_ascii=False)
        except ValueError:
            return t
    return t


@F.pandas_udf(T.StringType())
def _laid_out(s: pd.Series) -> pd.Series:
    return s.map(_spaced, na_action="ignore")


def action_text(c: Column) -> Column:
    """Text of an action: null is empty, JSON is laid out with ``", "`` and ``": "``, other text is stripped. Only what may be JSON goes to Python."""
    t = strip(c)
    json_ = t.rlike(r"^[\[{]")
    return F.when(c.isNull(), "").when(json_, _laid_out(F.when(json_, t))).otherwise(t)


def step_number(step: Column) -> Column:
    """``seed`` is 1, ``iterN`` is N, anything else null."""
    return F.when(step == "seed", F.lit(1).cast("bigint")).otherwise(F.regexp_extract(step, r"^iter(\d+)$", 1).try_cast("bigint"))


def name_list(c: Column) -> Column:
    """Parts of a comma list, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def scaled_size(width: Column, height: Column, max_pixels: int = 750_000) -> Column:
    """STRUCT<width, height> after scaling down to ``max_pixels``; each side is 1 at least."""
    s = F.sqrt(F.lit(float(max_pixels)) / (width * height))
    fit = lambda x: F.when(width * height > max_pixels, F.greatest(F.lit(1), F.floor(x * s))).otherwise(x).cast("bigint")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def bare_task(task: Column) -> Column:
    """A task id without white space, folders in front and a file ending; blank goes to null."""
    s = F.regexp_replace(F.trim(F.regexp_replace(task, r"(?U)^[\s​⁠﻿]+|[\s​⁠﻿]+$", "")), r"^.*[/\\]", "")
    return F.nullif(F.regexp_replace(s, r"(?i)\.jsonl?$", ""), F.lit(""))


def file_name(path: Column) -> Column:
    """The name of a file, whatever its escapes, folders and letter case; blank goes to null."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""), r"^.*[/\\]", "")), F.lit(""))


def task_of_file(name: Column) -> Column:
    """The task in ``{step}_{task_id}_step{n}_input.png``; other names tell none."""
    return F.nullif(F.regexp_extract(name, r"^(?:seed|iter\d+)_(.+)_step\d+_input\.png$", 1), F.lit(""))
