"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from veilmark.llm import exact_dedup, hard_negatives, host_rules, license_scan, line_dedup, mixing, near_dedup, packing, periodic, piece_lattice, suffix_index, token_planes, warc_zip
from veilmark.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest = token_planes.write(docs, shared_folder(spark, "planes"), tokenizer("byte_bpe_50k.json"), "byte")
    return token_planes.read(manifest)


@query()
def op2_suffix_index(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_index.spans(table(spark, folder, "documents"))


@query(
    r"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
    lines AS (
      SELECT doc_id, sum(n - 1) AS n FROM (
        SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2)
      GROUP BY 1),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n
      FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
    m AS (
      SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
    h AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS failed FROM b GROUP BY 1),
    s AS (SELECT sum(n)::DOUBLE AS n, sum(failed)::DOUBLE AS f, sum(n::DOUBLE * n) AS sq, count(*) AS k,
      sum(failed::DOUBLE * failed / n) AS spread FROM h),
    v AS (SELECT n, f / n AS mean, f / n * (1 - f / n) AS chance, n - sq / n - (k - 1) AS free, k, spread FROM s),
    e AS (SELECT mean, CASE WHEN chance > 0 AND free > 0
      THEN (spread - n * mean * mean - (k - 1) * chance) / (free * chance) ELSE 0 END AS alike FROM v),
    prior AS (SELECT mean, CASE WHEN alike > 0 THEN least(greatest(1 / alike - 1, 1), 10000) ELSE 10000 END AS weight
      FROM e),
    verdict AS (SELECT source, (failed + mean * weight) / (n + (mean * weight + (1 - mean) * weight)) AS host_rate
      FROM h, prior)
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT (b.source IS NOT NULL AND host_rate > 0.5) AS kept, host_rate
    FROM b JOIN verdict ON b.source IS NOT DISTINCT FROM verdict.source
    """
)
def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.judge(table(spark, folder, "documents"))


@query(
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, folder, "documents"))


@query()
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(packing.tokenise(docs, tokenizer("word_bpe_49k.json"), "word"))


@query(
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages),
    g AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY 1),
    j AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM p JOIN g USING (payload_digest))
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN first END AS refers_to FROM j
    """
)
def op6_warc_zip(spark: SparkSession, folder: str) -> DataFrame:
    packages = warc_zip.write(table(spark, folder, "pages"), shared_folder(spark, "packages"))
    page = warc_zip.page_of
    return warc_zip.read(packages, with_payload=False).select(
        page("record_id").try_cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to").try_cast("bigint")).alias("refers_to"),
    )


@query()
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(table(spark, folder, "documents")).drop("h")


@query()
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.summary(table(spark, folder, "documents"))


@query()
def op9_piece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    # The whole corpus: documents, and the turns of conversations.
    docs, turns = table(spark, folder, "documents"), table(spark, folder, "conversations")
    texts = docs.select("doc_id", "text").unionByName(turns.select("conv_id", "turn", "text"), allowMissingColumns=True)
    return piece_lattice.digests(
        texts, piece_lattice.pieces(spark, tokenizer("piece_bpe_32k.model")), ["doc_id", "conv_id", "turn"], fitted=True
    )


@query()
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.labels(table(spark, folder, "documents"))


@query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.runs(periodic.plant(table(spark, folder, "documents"))))


@query(
    r"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS turn
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1),
    w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
    p AS (SELECT *,
        coalesce(sum(3 * words) OVER o, 0) AS given, coalesce(sum(weight) OVER o, 0) AS used,
        sum(words) OVER () AS all_words, sum(weight) OVER () AS all_weight
      FROM w WINDOW o AS (ORDER BY 3.0 * words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT max(CAST(all_words - given AS DOUBLE) / CAST(all_weight - used AS DOUBLE)) AS reached FROM p),
    t AS (SELECT source, words, least(words * CAST(3 AS DOUBLE), weight * reached) AS target FROM w, l),
    a AS (SELECT d.doc_id, d.size, t.words, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, words AS source_size, target, CAST(
        greatest(0, least(start + size, quota) - start)
        + greatest(0, least(start + words + size, quota) - start - words)
        + greatest(0, least(start + 2 * words + size, quota) - start - 2 * words) AS BIGINT) AS taken
    FROM a
    """
)
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


@query(
    """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, v.r, v.vec_id, v.label,
        CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
      FROM v AS a CROSS JOIN v WHERE a.vec_id % 100 = 0 AND a.r <> v.r),
    p AS (
      SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor = s.anchor AND s.label <> s.anchor_label
        AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return hard_negatives.mine(
        vectors.filter(hard_negatives.usable("embedding")).select(
            F.col("vec_id").alias("id"), label.alias("label"), whole.alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")
        )
    )
