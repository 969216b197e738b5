"""Queries of the operators in this subpackage, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.defects import find_defects
from tracemill.llm.diverse import varied_subset
from tracemill.llm.history import repeated_queries
from tracemill.llm.homoglyph import look_classes, lookalike_pairs
from tracemill.llm.leaks import find_leaks
from tracemill.llm.mixing import mix_sources, shares_reached
from tracemill.llm.runs import collapse_runs
from tracemill.llm.splits import record_entities, related_groups, split_of
from tracemill.llm.sql import ORACLE as ORACLE
from tracemill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    return lookalike_pairs(table(spark, d, "documents"))


@query
def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of look-alikes of every document."""
    return look_classes(table(spark, d, "documents"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Longest runs of at least two neighbouring events that are the same."""
    return collapse_runs(table(spark, d, "trajectory_row")).where("n_rows >= 2").select("task_id", "run_no", "first_line_no", "last_line_no")


@query
def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run collapsed into one event with its count and duration."""
    return collapse_runs(table(spark, d, "trajectory_row"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every record that hangs together with others."""
    return related_groups(record_entities(table(spark, d, "verify_result"), table(spark, d, "dpo_sample"))).select("record_type", "record_id", "group_task_id")


@query
def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Train, validation or test of every record; a group is never parted."""
    g = related_groups(record_entities(table(spark, d, "verify_result"), table(spark, d, "dpo_sample")))
    return g.select("record_type", "record_id", "group_task_id", split_of(F.col("group_id")).alias("split"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of a test item; the exact check keeps matches without an edit."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).where("edits = 0").select("doc_id", "item_id")


@query
def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, with passages that differ by an edit, and how much was found."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The largest varied subset of each pool: of each screen the smallest image."""
    return varied_subset(table(spark, d, "image_vector")).select("pool_id", "image_id").distinct()


@query
def p4_selected(spark: SparkSession, d: str) -> DataFrame:
    """``top_n`` varied images of each pool, in order of picking, with the number of images each stands for."""
    k = table(spark, d, "selection_result").select("pool_id", F.col("top_n").cast("long").alias("k"))
    return varied_subset(table(spark, d, "image_vector"), wanted=k)



@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Queries that ask for the task of an earlier one, each with the first that asked for it."""
    return repeated_queries(table(spark, d, "generated_query")).distinct()


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective sides of preference pairs with the kind of defect."""
    return find_defects(table(spark, d, "dpo_sample")).distinct()


@query
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every mix as parts of documents, by shard and slot."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target"))


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    t = table(spark, d, "mix_target")
    return shares_reached(mix_sources(table(spark, d, "documents"), t), t)
