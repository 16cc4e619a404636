"""Delimited and JSON tables; every cell is text.

Delimited files are read in blocks.  Whether a block begins inside a quoted cell depends on all
blocks before it, but only by one bit: a first pass notes, for both cases, how each block ends, a
running composition per file turns that into the real beginning of every block, and a second
pass cuts the records.  A record that crosses blocks is put together from its pieces, all others
stay in their task, so quoted line breaks need no file to be read by one task.
"""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.common import stage
from veilmark.sources.files import list_files, open_bytes, open_random

SNIFF_ROWS = 20
BLOCK_BYTES = 32 << 20
POSITION = ("_path", "_block", "_line")
UNCLOSED = "quoted cell without end"
NO_COLUMNS = "no columns to read"
BAD_JSON = "invalid JSON"


class TableError(ValueError):
    pass


def sniff_csv(files: DataFrame) -> DataFrame:
    """``(path, skip, header, error)`` per file.

    The header is the first of the first 20 rows that has the most fields; *skip* counts
    the physical lines before it.  Each task reads just the head of its files.
    """

    def sniff(batches):
        for batch in batches:
            found = [_head(path) for path in batch["path"]]
            yield pd.DataFrame(
                {"path": batch["path"], "skip": [s for s, _, _ in found], "header": [h for _, h, _ in found],
                 "error": [e for _, _, e in found]}
            )

    return files.select("path").mapInPandas(sniff, "path string, skip int, header array<string>, error string")


def _head(path: str) -> tuple[int, list[str], str | None]:
    try:
        with io.TextIOWrapper(open_bytes(path), encoding="utf-8-sig", errors="replace", newline="") as lines:
            skip, header = header_of(lines)
        return skip, distinct_names(header), None if header else NO_COLUMNS
    except Exception as problem:  # belongs to this file
        return 0, [], str(problem)


def distinct_names(header: list[str]) -> list[str]:
    """Names that repeat get a number: ``note, note.1``."""
    seen: dict[str, int] = {}
    out, taken = [], set(header)
    for name in header:
        k = seen.get(name, 0)
        new = name
        while k and (new := f"{name}.{k}") in taken:
            k += 1
        seen[name] = k + 1
        taken.add(new)
        out.append(new)
    return out


def header_of(lines) -> tuple[int, list[str]]:
    reader = csv.reader(lines)
    rows, starts, line = [], [], 0
    for row in reader:
        rows.append(row)
        starts.append(line)
        line = reader.line_num
        if len(rows) == SNIFF_ROWS:
            break
    if not rows:
        return 0, []
    best = max(range(len(rows)), key=lambda i: (len(rows[i]), -i))
    return starts[best], rows[best]


def columns(spark: SparkSession, path: str | list[str], recursive: bool = False) -> list[str]:
    """Column names of CSV input, from the heads of the files only."""
    return common_header(sniff_csv(list_files(spark, path, recursive).filter("suffix = '.csv'")))[0]


def common_header(sniffed: DataFrame) -> tuple[list[str], int]:
    heads = sniffed.groupBy("header").agg(F.max("skip").alias("skip")).limit(2).collect()
    if not heads:
        raise TableError("no CSV files found")
    bad = sniffed.filter("error IS NOT NULL").first()
    if bad is not None:
        raise TableError(f"{bad['path']}: {bad['error']}")
    if len(heads) > 1:
        raise TableError(f"files differ in their header, e.g. {heads[0]['header']} and {heads[1]['header']}")
    return list(heads[0]["header"]), int(heads[0]["skip"])


# -- records -----------------------------------------------------------------------------------------

# A cell is quoted if a quote is its first character; behind the closing quote, and inside a cell that
# is not quoted, quotes are ordinary characters.
_QUOTED = r'(?:[^"]++|"")*+"[^,]*+'
_CELL = rf'(?:"{_QUOTED}|[^",][^,]*+|)'
_REST = rf"(?:,{_CELL})*+"
_WHOLE = re.compile(_CELL + _REST, re.DOTALL)
_CLOSING = re.compile(_QUOTED + _REST, re.DOTALL)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether *line* ends in an open quoted cell, given how it begins."""
    if '"' not in line:
        return inside
    return (_CLOSING if inside else _WHOLE).fullmatch(line) is None


def _blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """``(path, block, stop)``: byte ranges of files, dealt out evenly."""
    starts = F.expr(f"explode(sequence(0L, greatest(length - 1, 0L), {block_bytes}L))")
    ranges = files.select("path", "length", starts.alias("block"))
    n_parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.select("path", "block", F.least(F.col("block") + block_bytes, "length").alias("stop")).repartition(n_parts, "path", "block")


def block_lines(path: str, start: int, stop: int) -> list[str]:
    """The lines that begin in a byte range; breaks are kept as in the file, but for the one at the end."""
    with open_random(path) as source:
        size = source.size()
        source.seek(max(start - 1, 0))
        data = source.read(stop - max(start - 1, 0))
        # A line belongs to the block that its first byte lies in.
        if start > 0:
            cut = data.find(b"\n")
            if cut < 0:
                return []
            data = data[cut + 1 :]
            if not data:
                return []
        while data and not data.endswith(b"\n") and source.tell() < size:
            more = source.read(1 << 16)
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            if cut >= 0:
                break
    if start == 0 and data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    lines = data.decode("utf-8", errors="replace").split("\n")
    return lines if lines[-1] else lines[:-1]


def _endings(batches):
    """Per block how it ends if it begins outside (``end0``) or inside (``end1``) a quoted cell, and ``closes``."""
    for batch in batches:
        rows = []
        for path, start, stop in zip(*(batch[c] for c in ("path", "block", "stop"))):
            try:
                end0, end1, closes = False, True, False
                for line in block_lines(path, int(start), int(stop)):
                    same = end0 == end1
                    end0 = ends_inside(line, end0)
                    end1 = end0 if same else ends_inside(line, end1)
                    closes = closes or not end1
                rows.append((path, start, end0, end1, closes, None))
            except Exception as problem:  # belongs to this file
                rows.append((path, start, False, True, False, str(problem)))
        yield pd.DataFrame(rows, columns=["path", "block", "end0", "end1", "closes", "error"])


def csv_records(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(path, block, line, cells)`` of all records of *files* ``(path, length)``, and ``(path, error)``.

    ``line`` counts the lines of the block the record begins in.  Blank lines are no records.  Files with
    an error have no records.
    """
    ranges = stage(_blocks(files, block_bytes))
    ends = stage(ranges.mapInPandas(_endings, "path string, block bigint, end0 boolean, end1 boolean, closes boolean, error string"))
    # One short entry per block: 32 MB of a file take 30 bytes here.
    step = (
        "named_struct('inside', CASE WHEN acc.inside THEN b.end1 ELSE b.end0 END, "
        "'origin', CASE WHEN acc.inside AND NOT b.closes THEN acc.origin ELSE b.block END, "
        "'open', CASE WHEN acc.inside THEN array_append(acc.open, named_struct('block', b.block, 'origin', acc.origin)) ELSE acc.open END)"
    )
    zero = "named_struct('inside', false, 'origin', 0L, 'open', CAST(array() AS array<struct<block:bigint,origin:bigint>>))"
    listed = F.array_sort(F.collect_list(F.struct("block", "end0", "end1", "closes"))).alias("bs")
    per_file = ends.groupBy("path").agg(listed, F.max("error").alias("error"))
    state = stage(per_file.select("path", "error", F.expr(f"aggregate(bs, {zero}, (acc, b) -> {step})").alias("s")))
    errors = state.select("path", F.coalesce("error", F.when(F.col("s.inside"), F.lit(UNCLOSED))).alias("error")).filter("error IS NOT NULL")
    inside = state.select("path", F.explode("s.open").alias("o")).select("path", "o.block", F.col("o.origin").alias("origin"))
    fine = ranges.join(errors.select("path"), "path", "left_anti")
    placed = fine.join(inside, ["path", "block"], "left")
    kind = "path string, block bigint, line bigint, origin bigint, text string, cells array<string>"
    found = stage(placed.mapInPandas(_cut_records, kind))
    whole = found.filter("origin IS NULL").select("path", "block", "line", "cells")
    # A record that crosses blocks: its pieces in order, the first one names its place.
    pieces = found.filter("origin IS NOT NULL").groupBy("path", "origin").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("ps")
    )
    joined = pieces.select(
        "path", F.col("origin").alias("block"), F.get("ps", F.lit(0))["line"].alias("line"),
        F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("text"),
    ).mapInPandas(_parse_records, "path string, block bigint, line bigint, cells array<string>")
    return whole.unionByName(joined), errors


def _cells(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record.removesuffix("\r"), newline="")), [])


def _parse_records(batches):
    for batch in batches:
        yield batch.assign(cells=[_cells(t) for t in batch["text"]]).drop(columns="text")


def _cut_records(batches):
    """Records of each block; pieces of those that cross its edges come with the block they began in."""
    columns = ["path", "block", "line", "origin", "text", "cells"]
    csv.field_size_limit(1 << 31 - 1)
    for batch in batches:
        for path, start, stop, origin in zip(*(batch[c] for c in ("path", "block", "stop", "origin"))):
            inside = not pd.isna(origin)
            out, held, first = [], [], 0
            for k, line in enumerate(block_lines(path, int(start), int(stop))):
                if not held:
                    first = k
                held.append(line)
                now = ends_inside(line, inside if len(held) == 1 else True)
                if now:
                    continue
                text = "\n".join(held)
                if inside:
                    out.append((path, start, first, origin, text, None))
                elif text.strip():
                    out.append((path, start, first, None, None, _cells(text)))
                held, inside = [], False
            if held:
                out.append((path, start, first, origin if inside else start, "\n".join(held), None))
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"origin": "Int64", "block": "int64", "line": "int64"})


def csv_rows(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(_path, _block, _line, names, texts)`` below the headers of *files*, and ``(path, error)``.

    Empty cells are null.  A file with a record of more cells than its header has an error and no rows.
    """
    sniffed = stage(sniff_csv(files))
    records, errors = csv_records(files, block_bytes)
    data = records.join(sniffed.filter("error IS NULL"), "path").filter((F.col("block") > 0) | (F.col("line") > F.col("skip")))
    data = stage(data.select("path", "block", "line", "cells", F.col("header").alias("names")))
    wide = data.filter(F.size("cells") > F.size("names")).groupBy("path").agg(F.max(F.size("cells")).alias("n"), F.max(F.size("names")).alias("m"))
    too_wide = wide.select("path", F.format_string("a record has %d cells, the header %d", "n", "m").alias("error"))
    bad = sniffed.filter("error IS NOT NULL").select("path", "error")
    bad = bad.unionByName(errors.join(bad.select("path"), "path", "left_anti"))
    bad = stage(bad.unionByName(too_wide.join(bad.select("path"), "path", "left_anti")))
    texts = F.transform("names", lambda n, i: F.nullif(F.get("cells", i), F.lit("")))
    rows = data.join(bad.select("path"), "path", "left_anti").select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("line").alias("_line"), "names", texts.alias("texts")
    )
    return rows, bad


def read_csv(
    spark: SparkSession, path: str | list[str], recursive: bool = False, position: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """CSV files with one common header, preamble lines skipped, all columns text.

    With *position*, the columns ``_path, _block, _line`` give every row a key and an order.
    """
    return read_csv_files(list_files(spark, path, recursive).filter("suffix = '.csv'"), position, block_bytes)


def read_csv_files(files: DataFrame, position: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`read_csv` of listed *files*."""
    files = stage(files)
    header, _ = common_header(sniff_csv(files))
    rows, errors = csv_rows(files, block_bytes)
    bad = errors.first()
    if bad is not None:
        raise TableError(f"{bad['path']}: {bad['error']}")
    cells = [F.get("texts", F.lit(i)).alias(name) for i, name in enumerate(header)]
    return rows.select(*(POSITION if position else ()), *cells)


# -- JSON --------------------------------------------------------------------------------------------


def json_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(_path, _block, _line, names, texts, layout)`` of JSON *files*, and ``(path, error)``.

    A file holds an array of objects or one object and is read by one task.  Every row has its own names;
    ``layout`` has those of the file's first row.  Numbers keep their spelling, nested values are JSON.
    """
    kind = "_path string, _block bigint, _line bigint, names array<string>, texts array<string>, layout array<string>, error string"
    n_parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(files.select("path").repartition(n_parts, "path").mapInPandas(_parse_json, kind))
    errors = found.filter("error IS NOT NULL").select(F.col("_path").alias("path"), "error")
    return found.filter("error IS NULL").drop("error"), errors


def _parse_json(batches):
    columns = ["_path", "_block", "_line", "names", "texts", "layout", "error"]
    for batch in batches:
        for path in batch["path"]:
            try:
                with open_bytes(path) as source:
                    text = source.read().decode("utf-8-sig", errors="replace")
                found = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
                rows = found if isinstance(found, list) else [found]
                if not all(isinstance(r, dict) for r in rows):
                    raise ValueError("not objects")
            except ValueError:
                yield pd.DataFrame([(path, 0, 0, None, None, None, BAD_JSON)], columns=columns)
                continue
            except Exception as problem:  # belongs to this file
                yield pd.DataFrame([(path, 0, 0, None, None, None, str(problem))], columns=columns)
                continue
            layout = list(rows[0]) if rows else []
            for a in range(0, len(rows), 10_000):
                out = [(path, 0, k, list(r), [_json_text(v) for v in r.values()], layout, None) for k, r in enumerate(rows[a : a + 10_000], a)]
                yield pd.DataFrame(out, columns=columns)


class _Number(str):
    """A number as it was written."""


def _json_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else _nested(value)


def _nested(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_nested(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_nested, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def read_json(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Files that hold an array of objects or one object; numbers keep their spelling."""
    reader = spark.read.option("multiLine", True).option("primitivesAsString", True)
    return reader.json(path, recursiveFileLookup=recursive, pathGlobFilter="*.[jJ][sS][oO][nN]")


def write_table(df: DataFrame, target: str, columns: list[str], fmt: str = "csv", mode: str = "error") -> None:
    """Write a table with its columns in input order."""
    writer = df.select(*[f"`{c}`" for c in columns]).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(target)


def read_roster(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A roster file as ``(pos, full_name, email, username)``."""
    from veilmark.operators.roster import normalise

    rows = read_csv(spark, path, position=True)
    # A line has at least one byte, so positions stay in order within and across blocks.
    rows = rows.withColumn("_pos", F.col("_block") + F.col("_line")).drop(*POSITION)
    return normalise(rows, "_pos")
