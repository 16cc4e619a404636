"""E-mail corpora: raw messages to header block plus body.

A small parser turns every message into its headers and its readable parts; which of them
make up the text is decided by expressions over those arrays.
"""

from __future__ import annotations

import email
import email.policy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.patterns import MAIL_HEADERS
from veilmark.functions.scalars import strip_sql
from veilmark.functions.spans import lit
from veilmark.sources.html import text_of

_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("content", pa.string())]))
_HEADERS = pa.map_(pa.string(), pa.string())
_SHAPE = "path string, named map<string,string>, parts array<struct<kind:string,content:string>>, problem string"


def read_mail(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """``(path, headers, body, error, text)`` of every ``.eml`` file below *path*."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.[eE][mM][lL]")
        .load(path)
    )
    return mail_text(files)


def mail_text(raw: DataFrame) -> DataFrame:
    """Parse ``(path, content)`` rows; a message without anything readable is an error row.

    The body is the best part that is not empty: plain text before HTML before anything else, the
    first of its kind.
    """
    parsed = raw.select("path", "content").mapInArrow(_parse, _SHAPE)
    names = f"array({', '.join(lit(n) for n in MAIL_HEADERS)})"
    value = strip_sql("named[lower(n)]")
    lines = f"filter(transform({names}, n -> CASE WHEN {value} <> '' THEN concat(n, ': ', {value}) END), l -> l IS NOT NULL)"

    def first(kind: str) -> str:
        return f"try_element_at(transform(filter(parts, p -> {kind}), p -> p.content), 1)"

    chosen = parsed.select(
        "path", "problem", F.expr(f"array_join({lines}, '\\n')").alias("headers"),
        F.expr(first("p.kind = 'text/plain'")).alias("plain"), F.expr(first("p.kind = 'text/html'")).alias("html"),
        F.expr(first("p.kind NOT IN ('text/plain', 'text/html')")).alias("other"),
    )
    body = F.expr(f"coalesce(plain, {text_of('html')}, other)")
    filled = chosen.withColumn("body", body).withColumn("body", F.expr(f"CASE WHEN {strip_sql('body')} <> '' THEN body END"))
    empty = F.col("body").isNull() & (F.col("headers") == "")
    error = F.coalesce("problem", F.when(empty, F.lit("no readable content")))
    text = F.concat_ws("\n\n", F.nullif("headers", F.lit("")), "body")
    return filled.withColumn("error", error).select(
        "path", F.when(F.col("problem").isNull(), F.col("headers")).alias("headers"), "body", "error",
        F.when(F.col("error").isNull(), text).alias("text"),
    )


def _parse(batches):
    for batch in batches:
        named, parts, problems = [], [], []
        for content in batch.column(1).to_pylist():
            try:
                message = email.message_from_bytes(content or b"", policy=email.policy.compat32)
                # Of a header that repeats, the first counts.
                heads = {k.lower(): str(v) for k, v in reversed(message.items())}
                found = [{"kind": p.get_content_type(), "content": _content(p)} for p in message.walk() if not p.is_multipart()]
                named.append(list(heads.items()))
                # Parts that are no text count only where the message is nothing else.
                readable = [f for f in found if f["content"] and (f["kind"] in ("text/plain", "text/html") or len(found) == 1)]
                parts.append(readable)
                problems.append(None)
            except Exception as problem:  # one broken message must not stop the corpus
                named.append([])
                parts.append([])
                problems.append(f"unreadable message: {problem}")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(named, _HEADERS), pa.array(parts, _PARTS), pa.array(problems, pa.string())],
            names=["path", "named", "parts", "problem"],
        )


def _content(part) -> str:
    data = part.get_payload(decode=True) or b""
    return data.decode(part.get_content_charset() or "utf-8", errors="replace")
