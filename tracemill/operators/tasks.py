"""New tasks from generated queries, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import json_has, json_object, non_empty, strip
from tracemill.operators.ranks import number_rows
from tracemill.operators.resume import expect_complete

CHUNK = 10_000


def default_reference(query: Column, block_id: Column) -> Column:
    """``reference_config_id`` of a query's JSON; the block's id only where the member is absent (null and '' stay)."""
    return F.when(json_has(query, "reference_config_id"), F.get_json_object(query, "$.reference_config_id")).otherwise(block_id)


def config_id(reference: Column, own: Column) -> Column:
    """The first of the two that is not null or empty; null when both are."""
    return F.coalesce(non_empty(reference), non_empty(own))


def without_gaps(query: Column) -> Column:
    """A query's JSON without ``targets_student_gaps``."""
    kept = F.map_filter(F.from_json(query, "map<string,variant>"), lambda k, _: k != "targets_student_gaps")
    return F.to_json(kept)


def numbered_tasks(queries: DataFrame, order: list[str]) -> DataFrame:
    """``queries`` with an instruction, with ``task_no`` and ``task_id`` ``task1``, ``task2``, ... by ``order`` over all inputs."""
    n = number_rows(queries.where("instruction IS NOT NULL AND instruction <> ''"), order, "task_no")
    return n.withColumn("task_id", F.concat(F.lit("task"), F.col("task_no").cast("string")))


def materialize(queries: DataFrame, configs: DataFrame, on: str = "config_file") -> DataFrame:
    """Task rows of numbered queries and the configuration of their block's file; raises when a file is missing.

    What the configuration says goes before what the query says, but for the id.
    """
    expect_complete(queries, configs, [on])
    q = queries.select(on, F.col("task_id"), F.col("config_id").alias("_c"), F.col("instruction").alias("_i"))
    base = configs.drop("id", "task_id")
    out = q.join(base, on)
    first = lambda name, own: F.coalesce(F.col(name), F.col(own)).alias(name) if name in base.columns else F.col(own).alias(name)
    rest = [c for c in base.columns if c not in (on, "config_id", "instruction")]
    return out.select(F.col("task_id").alias("id"), first("config_id", "_c"), first("instruction", "_i"), *rest)


def manifest(tasks: DataFrame, keys: list[str], order: str = "task_id", chunk: int = CHUNK) -> DataFrame:
    """(keys, chunk, task_ids): ids per key in order, in chunks of ``chunk`` so that no list grows with the data."""
    n = number_rows(tasks.select(*keys, order), [*keys, order], "_n", 0)
    first = n.groupBy(*keys).agg(F.min("_n").alias("_first"))
    t = n.join(first, keys).withColumn("chunk", F.floor((F.col("_n") - F.col("_first")) / F.lit(chunk)))
    return t.groupBy(*keys, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", order))), lambda x: x[order]).alias("task_ids"))


def manifest_rows(manifests: DataFrame, json: str) -> DataFrame:
    """(domain, pos, task_id) of manifest documents, maps of domain to ids; anything else gives no row."""
    m = F.from_json(F.col(json), "map<string,array<string>>")
    t = manifests.select(F.explode(m).alias("domain", "_ids"))
    return t.select("domain", F.posexplode("_ids").alias("pos", "task_id"))


def upsert(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``registry`` with the rows of ``new`` in place of those of the same key; other keys stay."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new)


def instruction_lookup(tasks: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """(task_id, instruction, path): from the first of ``candidates`` (stem, json, path) that has a task's document and can be read.

    The instruction is stripped; one that is JSON null is the text ``None``, one that is absent is empty. Tasks without a document have nulls.
    """
    out = tasks.select("task_id").distinct()
    found = []
    for i, c in enumerate(candidates):
        said = F.when(json_has(F.col("json"), "instruction"), F.coalesce(F.get_json_object("json", "$.instruction"), F.lit("None"))).otherwise("")
        d = c.where(json_object(F.col("json")).isNotNull()).groupBy(F.col("stem").alias("task_id")).agg(F.min(F.struct("path", strip(said).alias("instruction"))).alias(f"_c{i}"))
        out, found = out.join(d, "task_id", "left"), [*found, F.col(f"_c{i}")]
    first = F.coalesce(*found)
    return out.select("task_id", first["instruction"].alias("instruction"), first["path"].alias("path"))


def first_ids(tasks: DataFrame, limit: int | None, key: str = "task_id") -> DataFrame:
    """The first ``limit`` tasks by id; all when it is None or not above 0."""
    return tasks.orderBy(key).limit(limit) if limit and limit > 0 else tasks
