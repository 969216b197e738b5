"""Scans of the files that runs, judges and generators leave.

Paths may be globs or lists. A folder with nothing to read gives an empty table
where a scan says so, and raises elsewhere. File stems are the keys; ids inside a
file are not trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions.text import strip

# Endings of image files.
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".webp", ".bmp"]


class SourceError(RuntimeError):
    """A source is missing or malformed."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def json_documents(spark: SparkSession, path: str, schema: str, name_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """One row per file with a typed object, its ``path`` and ``stem``; a malformed file raises when read."""
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    p = F.col("_metadata.file_path")
    return r.json(path).withColumn("path", p).withColumn("stem", stem(p))


def raw_documents(spark: SparkSession, path: str, name_glob: str = "*.json", objects_only: bool = True) -> DataFrame:
    """(path, stem, json) of whole files that are JSON, objects only by default; others drop out. A missing folder raises."""
    if not exists(spark, path):
        raise SourceError(f"{path} is missing")
    t = spark.read.option("pathGlobFilter", name_glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    v = F.try_parse_json("json")
    t = t.where(F.schema_of_variant(v).startswith("OBJECT") if objects_only else v.isNotNull())
    return t.withColumn("stem", stem(F.col("path"))).select("path", "stem", "json")


def env_configs(spark: SparkSession, path: str) -> DataFrame:
    """Environment configurations ``config*.json`` of a folder."""
    return json_documents(spark, path, schemas.ENV_CONFIG, "config*.json")


def task_configs(spark: SparkSession, path: str) -> DataFrame:
    """Task configurations with ``task_id``, the file's stem."""
    return json_documents(spark, path, schemas.TASK_CONFIG, "*.json").withColumn("task_id", F.col("stem"))


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, line_no, json) of JSON Lines files; blank lines are skipped and not numbered.

    A malformed line raises when strict, and drops out otherwise. Files are read whole, so that
    lines have their number in the file.
    """
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "json")).where(strip(F.col("json")) != "")
    ok = F.try_parse_json("json").isNotNull()
    if not strict:
        return t.where(ok)
    bad = F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("path")))
    return t.withColumn("json", F.when(ok, F.col("json")).otherwise(bad.cast("string")))


def trajectories(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(task_id, line_no, step_num, response, action, screenshot_file) of ``{task_id}/traj.jsonl`` files."""
    t = json_lines(spark, path, strict)
    r = F.from_json("json", schemas.TRAJECTORY_LINE)
    return t.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("task_id"), F.col("line_no").cast("bigint").alias("line_no"), r["step_num"].alias("step_num"), r["response"].alias("response"), r["action"].alias("action"), r["screenshot_file"].alias("screenshot_file"))


def discovered_tasks(spark: SparkSession, path: str, file: str = "traj.jsonl") -> DataFrame:
    """(task_id) of the folders below ``path`` that hold ``file``, in text order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/{file}")
    # a listing, as for any scan; a scan itself would pass over empty files
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return spark.createDataFrame([(f.getPath().getParent().getName(),) for f in found], "task_id STRING").orderBy("task_id")


def verify_results(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """Verdicts of a JSON list, those with a ``task_id``, with their place ``pos``; a missing file is empty.

    ``agent_pass`` that is no boolean is null.
    """
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], f"pos INT, {schemas.VERIFY_RESULT}")
        raise SourceError(f"{path} is missing")
    t = spark.read.text(path, wholetext=True)
    v = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    bad = F.raise_error(F.lit(f"{path} is no list")).cast("array<variant>")
    t = t.select(F.posexplode(F.when(v.isNotNull(), v).otherwise(bad)).alias("pos", "v"))
    t = t.where(F.schema_of_variant("v").startswith("OBJECT") & F.try_variant_get("v", "$.task_id", "string").isNotNull())
    r = F.from_json(F.to_json("v"), schemas.VERIFY_RESULT)
    return t.select("pos", r.alias("r")).select("pos", "r.*")


def screenshot_paths(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(pos, path) of a JSON list of paths; strict strips and raises on items that are no text, lenient drops them."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("pos", "v"))
    s = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    ok = F.coalesce(strip(s) != "", F.lit(False))
    if not strict:
        return t.where(ok).select("pos", s.alias("path"))
    bad = F.raise_error(F.concat(F.lit("item "), F.col("pos").cast("string"), F.lit(f" of {path} is no path"))).cast("string")
    return t.select("pos", F.when(ok, strip(s)).otherwise(bad).alias("path"))


def image_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path) of image files below the roots, each once, ordered by the parts of the path; missing roots are passed over."""
    found = [r for r in roots if exists(spark, r)]
    if not found:
        return spark.createDataFrame([], "path STRING")
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found).select("path")
    return t.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(IMAGE_ENDINGS)).distinct().orderBy(F.split("path", "/"))


def image_bytes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, score) of ``{task_id}/result.txt`` files; text that is no number is 0."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("task_id"), F.coalesce(strip(F.col("value")).try_cast("double"), F.lit(0.0)).alias("score"))


def cached_results(spark: SparkSession, path: str) -> DataFrame:
    """As ``verify_results``; a file that is corrupt or no list is empty as well."""
    empty = spark.createDataFrame([], f"pos INT, {schemas.VERIFY_RESULT}")
    if not exists(spark, path):
        return empty
    ok = spark.read.text(path, wholetext=True).where(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"))
    return empty if ok.isEmpty() else verify_results(spark, path)


def env_file(text: str, known: dict[str, str]) -> dict[str, str]:
    """Settings of a ``.env`` text; what is known already stays. Blank lines, comments and lines without ``=`` are skipped."""
    out = dict(known)
    for line in text.splitlines():
        name, is_, value = line.strip().partition("=")
        if is_ and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("'\""))
    return out
