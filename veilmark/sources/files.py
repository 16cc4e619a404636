"""Finding and opening files.

Folders are listed and files opened by tasks, with Arrow's file systems, which know local
paths as well as the usual cluster stores.  Unlike Spark's own readers this also sees empty
files and names that start with an underscore.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.patterns import BATCH_SUFFIXES
from veilmark.operators.common import stage

_LISTED = "path string, name string, length bigint, folder boolean, error string"


def resolve(path: str):
    """``(file system, path inside it, prefix of its paths)``."""
    from pyarrow import fs

    if "://" in path:
        scheme, rest = path.split("://", 1)
        if scheme != "file":
            system, inner = fs.FileSystem.from_uri(path)
            return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"
        path = rest
    elif path.startswith("file:"):
        path = path[len("file:"):]
    return fs.LocalFileSystem(), path, "file:"


def _children(batches):
    """The entries of each folder; a path that is a file is its own entry."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                system, inner, prefix = resolve(path)
                top = system.get_file_info(inner)
                if top.type == fs.FileType.NotFound:
                    raise FileNotFoundError(path)
                found = system.get_file_info(fs.FileSelector(inner)) if top.type == fs.FileType.Directory else [top]
                rows += [(prefix + f.path, f.base_name, f.size or 0, f.type == fs.FileType.Directory, None) for f in found]
            except Exception as problem:  # an unreadable folder must not hide the others
                rows.append((path, "", 0, False, str(problem)))
        yield pd.DataFrame(rows, columns=["path", "name", "length", "folder", "error"])


def list_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """``(path, name, suffix, length)``; file contents are not read.

    Folders are listed level by level, the folders of one level in parallel.
    """
    tops = [path] if isinstance(path, str) else list(path)
    level = stage(spark.createDataFrame([(p.rstrip("/") or "/",) for p in tops], "path string").mapInPandas(_children, _LISTED))
    bad = level.filter("error IS NOT NULL").first()
    if bad is not None:
        raise FileNotFoundError(bad["error"])
    files = [level.filter("NOT folder")]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while recursive and (folders := level.filter("folder AND error IS NULL")).limit(1).count():
        level = stage(folders.select("path").repartition(n_parts).mapInPandas(_children, _LISTED))
        files.append(level.filter("NOT folder"))
    found = reduce(DataFrame.unionByName, files).filter("error IS NULL")
    suffix = F.lower(F.regexp_extract("name", r"[^/](\.[^./]+)$", 1))
    return found.select("path", "name", "length", suffix.alias("suffix"))


def discover(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files a folder job takes: known suffix, neither hidden nor already redacted."""
    return list_files(spark, path, recursive).filter(
        ~F.col("name").startswith(".")
        & ~F.contains(F.col("name"), F.lit(".redacted"))
        & F.col("suffix").isin(*BATCH_SUFFIXES)
    )


def path_order(path: str = "path"):
    """Sort key that compares paths folder by folder."""
    return F.translate(F.col(path), "/", "\x01")


def open_bytes(path: str):
    """Open one file for reading inside a task."""
    system, inner, _ = resolve(path)
    return system.open_input_stream(inner)


def open_random(path: str):
    """Open one file inside a task for reading ranges of it."""
    system, inner, _ = resolve(path)
    return system.open_input_file(inner)


def write_bytes(path: str, data: bytes) -> None:
    """Write one file inside a task."""
    system, inner, _ = resolve(path)
    with system.open_output_stream(inner) as out:
        out.write(data)


def make_folder(path: str) -> None:
    """Make a folder where the store has folders."""
    system, inner, _ = resolve(path)
    system.create_dir(inner, recursive=True)
