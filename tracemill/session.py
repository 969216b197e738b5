"""Session factory and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC and AQE; ``master`` and partitions are left to the cluster when not given."""
    b = SparkSession.builder.appName("tracemill")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset (tests, one machine)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jsc = spark.sparkContext._jsc.sc()
        known = jsc.getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.sparkContext.setCheckpointDir(d)
        return jsc.getCheckpointDir().get()
    return d


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracemill_cut = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table ``cut`` wrote for ``df``, when no later plan reads it; does nothing for other frames."""
    path = getattr(df, "_tracemill_cut", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python finds it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tracemill_shipped", False):
        return
    here, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="tracemill-code-")
    atexit.register(shutil.rmtree, folder, True)  # served from here as long as the driver lives
    path = Path(folder, "tracemill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._tracemill_shipped = True
