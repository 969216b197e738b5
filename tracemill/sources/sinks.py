"""Sinks: tables at scale, single documents and files per task at the edge."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 100_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; works on the driver and on executors."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def put_file(path: str, data: bytes) -> None:
    """A file in one step: a task that is tried again writes the same file again."""
    at, p = file_system(path)
    at.create_dir(os.path.dirname(p), recursive=True)
    part = f"{p}.{os.getpid()}.part"
    with at.open_output_stream(part) as f:
        f.write(data)
    at.move(part, p)


def write_document(path: str, payload: Any) -> None:
    """One JSON document in UTF-8, indented by 2; folders are made."""
    put_file(path, (json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode())


def write_list(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None, most: int = SMALL) -> int:
    """Rows as one JSON list, in order. Streams to the file; raises beyond ``most`` rows, for which there is ``write_lines``."""
    cols = columns or df.columns
    at, p = file_system(path)
    at.create_dir(os.path.dirname(p), recursive=True)
    n = 0
    with at.open_output_stream(p + ".part") as f:
        for r in df.orderBy(*order).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).toLocalIterator():
            if n == most:
                raise ValueError(f"more than {most} rows for one document")
            f.write((("[\n" if not n else ",\n") + json.dumps(json.loads(r.j), ensure_ascii=False, indent=2)).encode())
            n += 1
        f.write(b"\n]\n" if n else b"[]\n")
    at.move(p + ".part", p)
    return n


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON Lines, ordered across and within files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results as they come, added to a table; readers sort by task and take the last of a key."""
    df.write.mode("append").parquet(path)


def write_per_task(df: DataFrame, folder: str, key: str, value: str) -> int:
    """One file ``{key}.json`` per row with the JSON text of ``value``, from the executors into a shared folder; returns the number written."""

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, v in zip(pdf[key], pdf[value]):
                put_file(f"{folder}/{k}.json", json.dumps(json.loads(v), ensure_ascii=False, indent=2).encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select(key, value).mapInPandas(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_manifest(manifests: DataFrame, path: str, domain: str = "domain", ids: str = "task_ids", chunk: str = "chunk") -> None:
    """Manifest document: domain to ids. Chunks of a domain are read one after the other."""
    out: dict[str, list[str]] = {}
    for r in manifests.orderBy(domain, chunk).toLocalIterator():
        out.setdefault(r[domain], []).extend(r[ids])
    write_document(path, out)


def upsert_registry(path: str, name: str, file_name: str) -> None:
    """The entry of a preference dataset in a registry document; other entries stay."""
    known, (at, p) = {}, file_system(path)
    if at.get_file_info(p).type != fs.FileType.NotFound:
        with at.open_input_stream(p) as f:
            known = json.loads(f.read())
    # The member names of a registry entry.
    known[name] = {"file_name": file_name, "ranking": True, "formatting": "sharegpt", "columns": {"messages": "conversations", "chosen": "chosen", "rejected": "rejected", "images": "images"}}
    write_document(path, known)


def copy_images(df: DataFrame, source: str, target: str, order: list[str]) -> int:
    """Copies of image files, each target once; the last source by ``order`` goes to a target named more than once."""
    pairs = df.groupBy(target).agg(F.max_by(source, F.struct(*order, source)).alias(source))

    def copy(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a, b in zip(pdf[source], pdf[target]):
                at, p = file_system(a)
                with at.open_input_stream(p) as f:
                    put_file(b, f.read())
            yield pd.DataFrame({"n": [len(pdf)]})

    return pairs.mapInPandas(copy, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_selection(df: DataFrame, folder: str, order: list[str], path: str, meta: dict[str, Any], most: int = SMALL) -> None:
    """A scored bundle and the bare list of paths of one selection (a top-k, so small)."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one selection")
    write_document(f"{folder}/selection.json", meta | {"selected": [r.asDict(recursive=True) for r in rows]})
    write_document(f"{folder}/paths.json", [r[path] for r in rows])
