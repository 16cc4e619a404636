"""One-time redaction of a folder: all files share one registry, each keeps its own columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.config import Settings, for_redact
from veilmark.functions import scalars as S
from veilmark.functions.patterns import BATCH_SUFFIXES
from veilmark.operators.common import stage
from veilmark.operators.summary import batch_outcome
from veilmark.plans.jobs import CellInput, TextInput, run
from veilmark.sources import files as FILES
from veilmark.sources import tables as T
from veilmark.sources.mail import mail_text

READ_SUFFIXES = (".txt", ".eml", ".csv", ".json")
ORDER = ["_place", "_block", "_line"]


@dataclass(frozen=True)
class FolderResult:
    """``files(path, output, error)``, ``texts(path, output, text)`` and ``rows(path, output, _block, _line, names, texts)``."""

    files: DataFrame
    texts: DataFrame
    rows: DataFrame
    registry: DataFrame

    def summary(self) -> DataFrame:
        return batch_outcome(self.files)

    def table(self, columns: Sequence[str]) -> DataFrame:
        """The rows of all files that have just these columns, as a table."""
        same = self.rows.filter(F.col("names") == F.array(*[F.lit(c) for c in columns]))
        return same.select(
            F.col("path").alias("_path"), "_block", "_line", *[F.get("texts", F.lit(i)).alias(c) for i, c in enumerate(columns)]
        )

    def lines(self) -> DataFrame:
        """``(path, output, _block, _line, text)``: every row as a line of its file's format, header left out."""
        quoted = F.transform("texts", lambda t: F.when(t.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(t, F.lit(""))))
        as_json = F.to_json(F.map_from_arrays("names", "texts"), {"ignoreNullFields": "false"})
        text = F.when(F.lower("path").endswith(".json"), as_json).otherwise(F.array_join(quoted, ","))
        return self.rows.select("path", "output", "_block", "_line", text.alias("text"))


def _read_whole(batches):
    """Content of each file; a file that cannot be read has an error."""
    for batch in batches:
        for path in batch["path"]:
            try:
                with FILES.open_bytes(path) as source:
                    row = (path, source.read(), None)
            except Exception as problem:  # belongs to this file
                row = (path, None, str(problem))
            # One file at a time, so memory holds one.
            yield pd.DataFrame([row], columns=["path", "content", "error"])


def _texts(found: DataFrame) -> DataFrame:
    """``(path, text, error)`` of the text and mail files."""
    n_parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = found.filter(F.col("suffix").isin(".txt", ".eml")).select("path", "suffix")
    raw = stage(wanted.select("path").repartition(n_parts, "path").mapInPandas(_read_whole, "path string, content binary, error string"))
    raw = raw.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    unread = raw.filter("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("text"), "error")
    fine = raw.filter("error IS NULL")
    plain = fine.filter("suffix = '.txt'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "error")
    mail = mail_text(fine.filter("suffix = '.eml'")).select("path", "text", "error")
    return unread.unionByName(plain).unionByName(mail)


def redact_folder(
    spark: SparkSession,
    path: str,
    settings: Settings | None = None,
    *,
    recursive: bool = False,
    profile: str | None = None,
    passthrough: Iterable[str] = (),
    block_bytes: int = T.BLOCK_BYTES,
) -> FolderResult:
    """Redact every supported file of a folder, numbering values in path order.

    Files that cannot be read get an error and do not stop the rest.  Word, PDF, Outlook
    and spreadsheet files are listed as errors: extract their text first.  The anchor of a table
    is looked for in the columns of its own file.
    """
    job = for_redact(settings or Settings(), profile, passthrough)
    found = stage(FILES.discover(spark, path, recursive))
    texts = stage(_texts(found))
    zero = F.lit(0).cast("bigint")
    readable = texts.filter(F.col("error").isNull()).withColumns(
        {"_place": FILES.path_order(), "_block": zero, "_line": zero}
    )
    csv, bad_csv = T.csv_rows(found.filter("suffix = '.csv'"), block_bytes)
    json, bad_json = T.json_rows(found.filter("suffix = '.json'"))
    rows = stage(
        csv.withColumn("layout", F.col("names")).unionByName(json).withColumn("_place", FILES.path_order("_path"))
    )
    result = run(
        {
            "texts": TextInput(readable, "text", ["path"], ORDER),
            "rows": CellInput(rows, list(T.POSITION), ORDER),
        },
        job, interleave=True,
    )
    errors = texts.select("path", "error").filter("error IS NOT NULL").unionByName(bad_csv).unionByName(bad_json)
    known = F.col("suffix").isin(*READ_SUFFIXES)
    unsupported = F.when(F.col("suffix").isin(*BATCH_SUFFIXES) & ~known, F.concat(F.lit("unsupported file type "), "suffix"))
    to_text = F.when(F.col("suffix") == ".eml", S.redacted_name(F.col("path"), ".txt"))
    output = F.coalesce(to_text, S.redacted_name(F.col("path")))
    listed = stage(
        found.join(errors, "path", "left").select("path", F.coalesce("error", unsupported).alias("error"), output.alias("output"))
        .withColumn("output", F.when(F.col("error").isNull(), F.col("output")))
        .select("path", "output", "error")
    )
    out_texts = result.outputs["texts"].select("path", "text").join(listed.select("path", "output"), "path")
    out_rows = result.outputs["rows"].withColumnRenamed("_path", "path").join(listed.select("path", "output"), "path")
    return FolderResult(
        listed,
        out_texts.select("path", "output", "text"),
        out_rows.select("path", "output", "_block", "_line", "names", "texts"),
        result.registry,
    )
