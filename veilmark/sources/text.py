"""Text corpora: one row per file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.sources.files import write_bytes


def read_texts(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """``(path, text)``; bytes that are not UTF-8 become replacement characters."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.make_valid_utf8(F.col("value")).alias("text")
    )


def write_texts(df: DataFrame, path_col: str = "output", text_col: str = "text") -> DataFrame:
    """Write each row to its own file; returns ``(output, error)`` rows, lazily.

    A failing file gives an error row and does not stop the others.
    """

    def write(batches):
        for batch in batches:
            errors = []
            for path, text in zip(batch["output"], batch["text"]):
                try:
                    write_bytes(path, (text or "").encode("utf-8"))
                    errors.append(None)
                except Exception as problem:  # any store error belongs to its file
                    errors.append(str(problem))
            yield pd.DataFrame({"output": batch["output"], "error": errors})

    rows = df.select(F.col(path_col).alias("output"), F.col(text_col).alias("text"))
    return rows.mapInPandas(write, "output string, error string")
