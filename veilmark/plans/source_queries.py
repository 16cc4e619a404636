"""Registered queries over sources: pages, mail, delimited files and folders.

Files are written by Spark from the given tables into a scratch folder next to the
checkpoints, so they grow with the tables and every executor can reach them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import scalars as S
from veilmark.operators.common import checkpoint_folder, stage
from veilmark.operators import registry as REG
from veilmark.plans import folder as FOLDER
from veilmark.plans import jobs
from veilmark.plans.queries import ENTS, query, table
from veilmark.sources import files as FILES
from veilmark.sources import registry_store as STORE
from veilmark.sources import tables as T
from veilmark.plans.sqltext import lit, numbered, rewritten
from veilmark.sources.html import MARKUP, RAW_CONTENT, html_text
from veilmark.sources.mail import mail_text
from veilmark.sources.text import read_texts, write_texts
from veilmark.streaming.stream import pseudonymise_stream


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _page_text() -> str:
    """The text of a page; the pages hold four kinds of character references."""
    markup = lit(MARKUP)
    known = "replace(replace(replace(replace(d, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', chr(34)), '&amp;', '&')"
    return f"""
      WITH cut AS (SELECT page_id, string_split_regex(html, {markup}) AS ds, regexp_extract_all(html, {markup}) AS ms FROM pages)
      SELECT page_id, array_to_string(list_filter(flatten(list_transform(range(1, len(ds) + 1), lambda i: [
        list_transform([ds[i]], lambda d: {known})[1], coalesce(regexp_extract(ms[i], {lit(RAW_CONTENT)}, 1), '')])),
        lambda p: p <> ''), ' ') AS text FROM cut"""


@query(_page_text())
def html_to_text(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", html_text("html").alias("text"))


@query(
    """
    SELECT doc_id, 'From: ' || source || '@corpus.example.com' || chr(10) || 'To: reader@corpus.example.com' || chr(10)
           || 'Subject: ' || lang || chr(10) || chr(10) || text AS text
    FROM documents"""
)
def email_corpus(spark, folder):
    """Each document as a raw multipart message, parsed back to header block and body."""
    head = F.concat(
        F.lit("From: "), "source", F.lit("@corpus.example.com\nTo:  reader@corpus.example.com \nSubject: "), "lang",
        F.lit("\nX-Other: dropped\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=bd7\n\n"),
        F.lit("--bd7\nContent-Type: text/html; charset=utf-8\n\n<p>only a fallback</p>\n"),
        F.lit("--bd7\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
    )
    raw = F.concat(head, F.base64(F.encode("text", "UTF-8")), F.lit("\n--bd7--\n"))
    messages = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content")
    )
    parsed = mail_text(messages)
    return parsed.select(F.col("path").cast("bigint").alias("doc_id"), "text")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, 'of "' || c_mktsegment || '", ' || c_nationkey AS remark
    FROM customer"""
)
def csv_preamble(spark, folder):
    """One delimited file per nation, each with lines ahead of its header."""
    remark = F.concat(F.lit('"of ""'), "c_mktsegment", F.lit('"", '), F.col("c_nationkey").cast("string"), F.lit('"'))
    rows = table(spark, folder, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("no"),
        F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", remark).alias("line"),
    )
    top = F.array(
        *[
            F.struct(F.lit(i - 3).cast("bigint").alias("no"), F.lit(line).alias("line"))
            for i, line in enumerate(("Customer report", "printed,for tests", "custkey,name,remark"))
        ]
    )
    heads = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.inline(top))
    target = scratch(spark, "csv")
    lines = rows.unionByName(heads.select("c_nationkey", "no", "line"))
    (
        lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "no")
        .select("c_nationkey", "line").write.partitionBy("c_nationkey").option("compression", "none")
        .mode("overwrite").format("text").save(target)
    )
    return T.read_csv_files(T.list_files(spark, target, True).filter("suffix = '.txt'"))


MANY = """
    SELECT CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment AS stem, c_nationkey % 5 AS kind, c_custkey AS k FROM customer"""


@query(
    f'''
    WITH c AS ({MANY}),
    lines AS (
      SELECT lpad(stem, 14, '0') || CASE kind WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '_q.csv' WHEN 3 THEN '.json' ELSE '_n.json' END AS file,
        kind, k, 'c' || k || '@x.example.com' AS mail, 'cust' || k AS person FROM c),
    mails AS (SELECT mail, row_number() OVER (ORDER BY file, CASE WHEN kind = 0 THEN -length(mail) END, k) AS n FROM lines),
    people AS (SELECT person, row_number() OVER (ORDER BY file, k) AS n FROM lines WHERE kind IN (1, 3)),
    done AS (
      SELECT file, kind, k, '[EMAIL_' || m.n || ']' AS mail, coalesce(p.n || '_C.', person) AS person, person AS was
      FROM lines JOIN mails m USING (mail) LEFT JOIN people p USING (person))
    SELECT file, CAST(NULL AS VARCHAR) AS error, string_agg('write to ' || mail || ' soon', chr(10) ORDER BY k) AS text
      FROM done WHERE kind = 0 GROUP BY file
    UNION ALL SELECT file, NULL, person || ',' || mail || ',' || k FROM done WHERE kind = 1
    UNION ALL SELECT file, NULL, person || ',"ask' || chr(10) || mail || ', ""now"""' FROM done WHERE kind = 2
    UNION ALL SELECT file, NULL, '{{"user_id":"' || person || '","n":"' || k || '","mail":"' || mail || '"}}' FROM done WHERE kind = 3
    UNION ALL SELECT file, NULL, '{{"contact":"' || mail || '","who":"' || person || '"}}' FROM done WHERE kind = 4
    UNION ALL SELECT 'bad' || r_regionkey || '.json', 'invalid JSON', NULL FROM region
    UNION ALL SELECT 'bad' || r_regionkey || '.csv', 'quoted cell without end', NULL FROM region
    UNION ALL SELECT 'none' || r_regionkey || '.csv', 'no columns to read', NULL FROM region
    UNION ALL SELECT 'old' || r_regionkey || '.docx', 'unsupported file type .docx', NULL FROM region
    UNION ALL SELECT '_e' || r_regionkey || '.txt', NULL, '' FROM region
    '''
)
def folder_batch(spark, folder):
    """A folder of texts, tables of five layouts, empty and broken files, redacted as one batch."""
    target = scratch(spark, "batch")
    k = F.col("c_custkey").cast("string")
    mail, person = F.concat(F.lit("c"), k, F.lit("@x.example.com")), F.concat(F.lit("cust"), k)
    kind = F.col("c_nationkey") % 5
    ends = F.array(*[F.lit(e) for e in (".txt", ".csv", "_q.csv", ".json", "_n.json")])
    stem = F.lpad(F.concat_ws("_", F.col("c_nationkey").cast("string"), "c_mktsegment"), 14, "0")
    line = (
        F.when(kind == 0, F.concat(F.lit("write to "), mail, F.lit(" soon")))
        .when(kind == 1, F.concat_ws(",", person, mail, k))
        .when(kind == 2, F.concat(person, F.lit(',"ask\n'), mail, F.lit(', ""now"""')))
        .when(kind == 3, F.concat(F.lit('{"user_id": "'), person, F.lit('", "n": '), k, F.lit(', "mail": "'), mail, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"contact": "'), mail, F.lit('", "who": "'), person, F.lit('"}')))
    )
    heads = F.array(*[F.lit(h) for h in ("", "user_id,note,note\n", "who,note\n", "[", "[")])
    joints = F.array(*[F.lit(j) for j in ("\n", "\n", "\n", ",\n", ",\n")])
    tails = F.array(*[F.lit(t) for t in ("", "\n", "\n", "]", "]")])
    # Each file is a group of customers that one program would have written.
    many = table(spark, folder, "customer").groupBy(F.concat(stem, F.get(ends, kind)).alias("file"), kind.alias("kind")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("ls")
    )
    body = F.concat(F.get(heads, F.col("kind")), F.array_join(F.transform("ls", lambda x: x["line"]), "\x00"), F.get(tails, F.col("kind")))
    written = many.select("file", F.replace(body, F.lit("\x00"), F.get(joints, F.col("kind"))).alias("text"))
    r = F.col("r_regionkey").cast("string")
    odd = {("bad", ".json"): "{oops", ("bad", ".csv"): 'a,b\n1,"x\n', ("none", ".csv"): "", ("old", ".docx"): "-", ("_e", ".txt"): "", ("y", ".png"): "-", ("z", ".redacted.txt"): "-"}
    for (start, end), text in odd.items():
        written = written.unionByName(table(spark, folder, "region").select(F.concat(F.lit(start), r, F.lit(end)).alias("file"), F.lit(text).alias("text")))
    outputs = written.select(F.concat(F.lit(f"{target}/"), "file").alias("output"), "text")
    FILES.make_folder(target)
    failed = stage(write_texts(outputs)).filter("error IS NOT NULL").first()
    if failed is not None:
        raise OSError(failed["error"])
    done = FOLDER.redact_folder(spark, target)
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    none = F.lit(None).cast("string")
    return (
        done.texts.select(file, none.alias("error"), "text")
        .unionByName(done.lines().select(file, none.alias("error"), "text"))
        .unionByName(done.files.filter("error IS NOT NULL").select(file, "error", none.alias("text")))
    )


@query("SELECT doc_id, 'out/' || doc_id || '.v1.redacted.txt' AS redacted, 'out/' || doc_id || '.v1.restored.eml' AS restored FROM documents")
def output_names(spark, folder):
    path = F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".v1.eml"))
    return table(spark, folder, "documents").select(
        "doc_id", S.redacted_name(path, ".txt").alias("redacted"), S.restored_name(path).alias("restored")
    )


BATCH_OF = "CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END"


@query(
    f"""{ENTS}, placed AS (SELECT ents.*, {BATCH_OF} AS batch FROM ents JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
    {numbered('placed', 'batch, doc_id, rnk')},
    pairs AS (SELECT placed.doc_id, placed.value, reg.token FROM placed JOIN reg USING (value))
    {rewritten('documents', 'doc_id', 'text', 'pairs')}"""
)
def stream_tokens(spark, folder):
    """The documents arrive language by language; every batch continues the tokens of those before."""
    target = scratch(spark, "stream")
    docs = table(spark, folder, "documents").select("doc_id", "text", F.expr(BATCH_OF).alias("batch"))
    shape = "doc_id bigint, text string"
    for k in range(3):
        docs.filter(F.col("batch") == k).drop("batch").write.parquet(f"{target}/in/batch={k}")
        arriving = spark.readStream.schema(shape).option("recursiveFileLookup", True).parquet(f"{target}/in")
        query_ = pseudonymise_stream(
            arriving, "text", ["doc_id"], f"{target}/registry", f"{target}/out", f"{target}/state", buckets=16
        )
        query_.awaitTermination()
    return spark.read.parquet(f"{target}/out").select("doc_id", "text")


@query("SELECT 's' || s_suppkey || '.txt' AS file, s_name || chr(10) || 'Straße ' || s_suppkey AS text FROM supplier")
def text_files(spark, folder):
    """One file per supplier, written by tasks and read back whole."""
    target = scratch(spark, "texts")
    FILES.make_folder(target)
    k = F.col("s_suppkey").cast("string")
    out = table(spark, folder, "supplier").select(
        F.concat(F.lit(f"{target}/s"), k, F.lit(".txt")).alias("output"), F.concat("s_name", F.lit("\nStraße "), k).alias("text")
    )
    failed = stage(write_texts(out)).filter("error IS NOT NULL").first()
    if failed is not None:
        raise OSError(failed["error"])
    return read_texts(spark, target).select(F.element_at(F.split("path", "/"), -1).alias("file"), "text")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS "Kunde Nr", 'a "b", ' || c_name || chr(10) || 'ü' AS note, CAST(NULL AS VARCHAR) AS empty,
    CAST(c_nationkey AS VARCHAR) AS nation FROM customer"""
)
def table_files(spark, folder):
    """A table written as delimited files, columns in order, and read back by its header."""
    target = scratch(spark, "table")
    note = F.concat(F.lit('a "b", '), "c_name", F.lit("\nü"))
    src = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Kunde Nr"), note.alias("note"), F.lit(None).cast("string").alias("empty"), F.col("c_nationkey").alias("nation")
    )
    T.write_table(src, target, ["Kunde Nr", "note", "empty", "nation"])
    if T.columns(spark, target) != src.columns:
        raise T.TableError("the columns have changed")
    return T.read_csv(spark, target)


@query(f"{ENTS}, {numbered('ents', 'doc_id, rnk')} SELECT value, token FROM reg")
def registry_saved(spark, folder):
    """The registry of a run, saved twice, cleared, saved and loaded."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    registry = jobs.pseudonymise_text(docs, "text", ["doc_id"]).registry
    target = scratch(spark, "saved")
    STORE.save(registry.limit(0), target)
    STORE.save(registry, target)
    STORE.clear(spark, target)
    STORE.save(STORE.load(spark, target).unionByName(registry), target)
    return REG.forward(STORE.load(spark, target))
