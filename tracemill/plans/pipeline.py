"""Named stages and the loop over iterations.

Every stage is a function of (session, state, step) that reads tables and writes
one; a stage whose table is there already is passed over, so a run can be taken up
again. The last iteration generates nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracemill.sources.files import exists


@dataclass
class Stage:
    """A table made from others; ``last`` tells whether it is made in the last iteration too."""

    name: str
    make: Callable[[SparkSession, Callable[[str, str], DataFrame], str], DataFrame]
    last: bool = True


@dataclass
class Options:
    """Where tables lie and what the agents are called; names are never fixed in code."""

    root: str
    steps: Sequence[str] = ("seed", "iter2", "iter3", "iter4", "iter5")
    student: str = "student"
    teacher: str = "teacher"
    max_attempts: int = 3
    top_n: int = 20
    knn_k: int = 20
    queries_per_config: int = 3
    history_turns: int = 4
    extra: dict = field(default_factory=dict)


def table_path(o: Options, step: str, name: str) -> str:
    return f"{o.root}/step={step}/{name}"


def run(spark: SparkSession, o: Options, stages: Sequence[Stage], only: Sequence[str] | None = None) -> list[tuple[str, str, bool]]:
    """Runs stages step by step; returns (step, stage, whether it was made now)."""
    done = []

    def read(step: str, name: str) -> DataFrame:
        return spark.read.parquet(table_path(o, step, name))

    for step in o.steps:
        for s in stages:
            if only and s.name not in only or not s.last and step == o.steps[-1]:
                continue
            path = table_path(o, step, s.name)
            made = not exists(spark, path + "/_SUCCESS")
            if made:
                s.make(spark, read, step).write.mode("overwrite").parquet(path)
            done.append((step, s.name, made))
    return done
