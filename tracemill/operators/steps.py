"""Steps of recorded runs: merging, grouping, shifting and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import action_text
from tracemill.operators.dedupe import keep_first

RUN = ["task_id", "run_no"]
SEGMENT = 4096


def delivered_once(rows: DataFrame, run: list[str] = RUN) -> DataFrame:
    """One row per line of a run; of repeated deliveries the earliest."""
    return keep_first(rows, [*run, "line_no"], ["ingested_at"])


def island_numbers(df: DataFrame, run: list[str], order: str, value: str, out: str = "group_no", segment: int = SEGMENT) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... for stretches of equal ``value`` (null equals null) in a run, by ``order``.

    Windows go over segments of ``segment`` orders, so a long run is spread over tasks; what passes
    from one segment to the next is a row per segment.
    """
    w = W.partitionBy(*run, "_seg").orderBy(order)
    t = df.withColumn("_seg", F.floor(F.col(order) / F.lit(segment)))
    t = t.withColumn("_first", F.row_number().over(w) == 1)
    t = t.withColumn("_new", F.when(F.col("_first") | F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    s = t.groupBy(*run, "_seg").agg(F.sum("_new").alias("_n"), F.min_by(F.struct(F.col(value).alias("v")), order).alias("_head"), F.max_by(F.struct(F.col(value).alias("v")), order).alias("_tail"))
    v = W.partitionBy(*run).orderBy("_seg")
    before = F.lag("_tail").over(v)
    s = s.withColumn("_open", F.when(before.isNotNull() & before["v"].eqNullSafe(F.col("_head")["v"]), 0).otherwise(1))
    s = s.withColumn("_base", F.sum(F.col("_n") + F.col("_open")).over(v.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    keys = [*run, "_seg"]
    s = s.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    t = t.withColumn("_at", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.join(s, on).withColumn(out, F.col("_base") + F.col("_at")).select(*df.columns, out)


def merge_consecutive(rows: DataFrame, run: list[str] = RUN, segment: int = SEGMENT) -> DataFrame:
    """Neighbouring lines of one step_num become one step (null equals null, a later return is a new step).

    First response, non-empty action texts by line, last screenshot and the number of lines.
    """
    t = rows.select(*run, "line_no", "step_num", "response", "screenshot_file", action_text(F.col("action")).alias("act"))
    t = island_numbers(t, run, "line_no", "step_num", segment=segment)
    acts = F.array_sort(F.collect_list(F.when(F.col("act") != "", F.struct("line_no", "act"))))
    g = t.groupBy(*run, "group_no").agg(F.min("step_num").alias("step_num"), F.min_by("response", "line_no").alias("response"), acts.alias("_acts"), F.max_by("screenshot_file", "line_no").alias("screenshot_file"), F.count("*").alias("n_lines"))
    return g.select(*run, "group_no", "step_num", "response", F.array_join(F.transform("_acts", lambda x: x["act"]), "\n").alias("action"), "screenshot_file", "n_lines")


def group_by_step(rows: DataFrame, run: list[str] = RUN) -> DataFrame:
    """All lines of a step_num become one step, wherever they stand; a missing number is 0. Null actions stay in the list."""
    t = rows.withColumn("step", F.coalesce(F.col("step_num").cast("int"), F.lit(0)).cast("bigint"))
    acts = F.array_sort(F.collect_list(F.struct("line_no", "action")))
    g = t.groupBy(*run, "step").agg(F.min_by("response", "line_no").alias("response"), acts.alias("_acts"), F.max_by("screenshot_file", "line_no").alias("screenshot_file"))
    return g.select(*run, "step", "response", F.transform("_acts", lambda x: x["action"]).alias("actions"), "screenshot_file")


def _earlier(steps: DataFrame, value: str, turns: int, order: str, run: list[str], segment: int) -> DataFrame:
    """``steps`` with ``_earlier``: ARRAY<STRUCT<v>> of ``value`` of the last ``turns`` steps before each, oldest first.

    Windows go over segments of ``segment`` orders, so a long run is spread over tasks; what passes from
    one segment to the next are its last ``turns`` values.
    """
    t = steps.withColumn("_seg", F.floor(F.col(order) / F.lit(segment))).withColumn("_v", F.struct(F.col(value).alias("v")))
    keys = [*run, "_seg"]
    last = t.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= turns)
    tails = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_v"))), lambda x: x["_v"]).alias("_tail"))
    before = F.flatten(F.collect_list("_tail").over(W.partitionBy(*run).orderBy("_seg").rowsBetween(-turns, -1)))
    tails = tails.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_before"))
    t = t.withColumn("_own", F.collect_list("_v").over(W.partitionBy(*keys).orderBy(order).rowsBetween(-turns, -1)))
    t = t.join(tails, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    all_ = F.concat("_before", "_own")
    n = F.least(F.size(all_), F.lit(turns))
    return t.select(*steps.columns, F.when(n > 0, F.slice(all_, F.greatest(F.size(all_) - n + 1, F.lit(1)), n)).otherwise(all_).alias("_earlier"))


def input_screenshot(steps: DataFrame, order: str = "step", run: list[str] = RUN, segment: int = SEGMENT) -> DataFrame:
    """The screenshot a step begins with: that of the step before, the first step's own; a null before stays null."""
    t = _earlier(steps, "screenshot_file", 1, order, run, segment)
    return t.withColumn("input_screenshot", F.when(F.size("_earlier") == 0, F.col("screenshot_file")).otherwise(F.get("_earlier", F.lit(0))["v"])).drop("_earlier")


def history(steps: DataFrame, turns: int = 4, order: str = "step", run: list[str] = RUN, segment: int = SEGMENT) -> DataFrame:
    """The responses of the last ``turns`` steps before each step, oldest first; null responses are kept as empty."""
    t = _earlier(steps, "response", turns, order, run, segment)
    return t.withColumn("history", F.transform("_earlier", lambda x: F.coalesce(x["v"], F.lit("")))).drop("_earlier")
