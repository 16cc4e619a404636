"""Registered queries: each reads whole tables and exercises operators of the library.

``QUERIES`` maps a name to a function of (spark, folder); ``SQL`` holds the equivalent
statement where plain SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.config import Settings, passthrough_for_redact, passthrough_for_tokens
from veilmark.functions import patterns as P
from veilmark.functions import scalars as S
from veilmark.functions import spans as SP
from veilmark.operators import audit as AUD
from veilmark.operators import detect as DET
from veilmark.operators import dictionary as D
from veilmark.operators import events as E
from veilmark.operators import profile as PRO
from veilmark.operators import registry as REG
from veilmark.operators import restore as RES
from veilmark.operators import roster as ROS
from veilmark.operators import structured as STR
from veilmark.operators import subject as SUB
from veilmark.operators import summary as SUM
from veilmark.plans import jobs
from veilmark.plans.sqltext import (
    REDACT_TIERS,
    STANDARD_TIERS,
    lit,
    numbered,
    rewritten,
    settled,
    spans,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- detection ------------------------------------------------------------------


def _detect(etype: str, source, key: str, from_sql: str) -> None:
    def run(spark, folder):
        df = source(spark, folder)
        found = df.select(key, F.expr(SP.rule_spans("text", P.PATTERN_RULES[etype])).alias("spans"))
        return DET.span_rows(found, [key], "spans").select(key, "value")

    sql = f"WITH src AS ({from_sql}) SELECT {key}, value FROM ({spans('src', key, 'text', etype)})"
    query(sql, f"detect_{etype.lower()}")(run)


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def _pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))


def _accounts(spark, folder):
    """Account numbers with varying check digits, some of them valid."""
    k = F.col("c_custkey")
    check = F.lpad((k % 97 + 2).cast("string"), 2, "0")
    number = F.lpad(k.cast("string"), 14, "0")
    text = F.concat(F.lit("pay to GB"), check, F.lit("NWBK"), number, F.lit(" today"))
    return table(spark, folder, "customer").select("c_custkey", text.alias("text"))


def _adapters(spark, folder):
    h = F.lower(F.lpad(F.hex("s_suppkey"), 8, "0"))
    parts = [F.substring(h, i, 2) for i in (1, 3, 5, 7)]
    text = F.concat(F.lit("adapter 00-1a-"), F.concat_ws("-", *parts), F.lit(" up"))
    return table(spark, folder, "supplier").select("s_suppkey", text.alias("text"))


def _amounts(spark, folder):
    whole = F.floor("o_totalprice").cast("string")
    text = F.concat(F.lit("order of $"), whole, F.lit(".50, about "), whole, F.lit(" EUR"))
    return table(spark, folder, "orders").select("o_orderkey", text.alias("text"))


PAGE_TEXT = "SELECT page_id, url || ' ' || html AS text FROM pages"
for _etype in ("EMAIL", "PHONE", "IP", "CREDIT_CARD"):
    _detect(_etype, _documents, "doc_id", "SELECT doc_id, text FROM documents")
for _etype in ("URL", "DOMAIN"):
    _detect(_etype, _pages, "page_id", PAGE_TEXT)
_detect(
    "IBAN_CODE", _accounts, "c_custkey",
    "SELECT c_custkey, 'pay to GB' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') || 'NWBK'"
    " || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || ' today' AS text FROM customer",
)
_detect(
    "MAC_ADDRESS", _adapters, "s_suppkey",
    "SELECT s_suppkey, 'adapter 00-1a-' || substr(h, 1, 2) || '-' || substr(h, 3, 2) || '-' || substr(h, 5, 2)"
    " || '-' || substr(h, 7, 2) || ' up' AS text FROM (SELECT s_suppkey, printf('%08x', s_suppkey) AS h FROM supplier)",
)
_detect(
    "AMOUNT", _amounts, "o_orderkey",
    "SELECT o_orderkey, 'order of $' || w || '.50, about ' || w || ' EUR' AS text"
    " FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS w FROM orders)",
)


ADDRESSES = """
    SELECT s_suppkey, 'from ' || CASE s_suppkey % 4
      WHEN 0 THEN '2001:db8:' || printf('%x', s_suppkey) || '::8a2e:370:7334' WHEN 1 THEN 'fe80::' || printf('%x', s_suppkey) || ':1'
      WHEN 2 THEN '1:2:3:4:5:6:7:' || printf('%x', s_suppkey) ELSE '::ffff:10.0.0.' || (s_suppkey % 256) END
      || ', not 12:30:45 or a::b, 1::2::3, 1:2:3:4:5:6:7:8:9 and x' || s_suppkey || '::y.' AS text FROM supplier"""


@query(f"WITH src AS ({ADDRESSES}) SELECT s_suppkey, value FROM ({spans('src', 's_suppkey', 'text', 'IP', P.IPV6_RULE)})")
def detect_ipv6(spark, folder):
    k = F.col("s_suppkey")
    x = F.lower(F.hex(k))
    kind = k % 4
    address = (
        F.when(kind == 0, F.concat(F.lit("2001:db8:"), x, F.lit("::8a2e:370:7334")))
        .when(kind == 1, F.concat(F.lit("fe80::"), x, F.lit(":1")))
        .when(kind == 2, F.concat(F.lit("1:2:3:4:5:6:7:"), x))
        .otherwise(F.concat(F.lit("::ffff:10.0.0."), (k % 256).cast("string")))
    )
    rest = F.concat(F.lit(", not 12:30:45 or a::b, 1::2::3, 1:2:3:4:5:6:7:8:9 and x"), k.cast("string"), F.lit("::y."))
    src = table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("from "), address, rest).alias("text"))
    settings = Settings()
    rows = _entity_rows(src, "s_suppkey", settings)
    return rows.filter(F.col("etype") == "IP").filter(F.contains("value", F.lit(":"))).select("s_suppkey", "value")


@query(
    """
    WITH src AS (SELECT c_custkey, c_custkey % 3 AS kind,
                   'land' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS land
                 FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, 'www.c' || c_custkey || '.' || CASE kind WHEN 0 THEN land ELSE 'CO.' || land END AS value
    FROM src WHERE kind < 2"""
)
def detect_domain_suffixes(spark, folder):
    """Domain endings from a table: one per nation, and ``co.`` before it."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("land"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")).alias("land"))
    suffixes = nation.select("land").union(nation.select(F.concat(F.lit(".co."), "land"))).toDF("suffix")
    k = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 3
    ending = F.when(kind == 0, F.col("land")).when(kind == 1, F.concat(F.lit("CO."), "land")).otherwise(F.concat("land", F.lit("x")))
    src = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit("see www.c"), k, F.lit("."), ending, F.lit(" or file.com today")).alias("text")
    )
    rows = _entity_rows(src, "c_custkey", Settings(domain_suffixes=suffixes))
    return rows.filter("etype = 'DOMAIN'").select("c_custkey", "value")


@query(f"SELECT doc_id, value FROM ({spans('documents', 'doc_id', 'text', 'SECRET', P.SECRET_RULE)})")
def detect_secrets(spark, folder):
    """Keys and passwords by the entropy of their characters."""
    found = DET.detect(_documents(spark, folder), "text", ["doc_id"], Settings(rules=[P.SECRET_RULE]))
    return DET.span_rows(found, ["doc_id"]).filter("etype = 'SECRET'").select("doc_id", "value")


def _entity_rows(df: DataFrame, key: str, settings: Settings) -> DataFrame:
    return DET.span_rows(DET.detect(df, "text", [key], settings, only_allowed=True), [key])


ENTS = "WITH " + settled("documents", "doc_id", "text", STANDARD_TIERS)
REDACT_ENTS = "WITH " + settled("documents", "doc_id", "text", REDACT_TIERS)


@query(f"{ENTS} SELECT doc_id, etype, value, s AS start_at, e AS end_at, score FROM ents")
def span_offsets(spark, folder):
    rows = _entity_rows(_documents(spark, folder), "doc_id", Settings())
    return rows.select("doc_id", "etype", "value", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "score")


@query(
    f"WITH src AS ({PAGE_TEXT}), " + settled("src", "page_id", "text", ["URL", "DOMAIN"])
    + " SELECT page_id, etype, value, s AS start_at, CAST(rnk - 1 AS INTEGER) AS rank FROM ents"
)
def resolve_overlaps(spark, folder):
    both = ", ".join(SP.rule_spans("text", P.PATTERN_RULES[t]) for t in ("URL", "DOMAIN"))
    found = _pages(spark, folder).select("page_id", F.expr(SP.drop_overlaps(f"concat({both})")).alias("spans"))
    return DET.span_rows(found, ["page_id"], "spans").select(
        "page_id", "etype", "value", F.col("start").alias("start_at"), "rank"
    )


PASSAGES = """
    WITH terms AS (SELECT DISTINCT lower(text) AS term FROM benchmark),
    found AS (SELECT d.doc_id, t.term, lower(d.text) AS low FROM documents d JOIN terms t
              ON contains(lower(d.text), t.term))
    SELECT doc_id, term, CAST((length(low) - length(replace(low, term, ''))) / length(term) AS BIGINT) AS occurrences
    FROM found"""


def _passages(spark, folder, settings: Settings) -> DataFrame:
    terms = table(spark, folder, "benchmark").select(F.col("text").alias("term")).distinct()
    dictionary = D.load(spark, settings.with_(company_terms=terms))
    rows = DET.span_rows(D.find(_documents(spark, folder), ["doc_id"], "text", dictionary), ["doc_id"], "spans")
    return rows.groupBy("doc_id", F.lower("value").alias("term")).agg(F.count(F.lit(1)).alias("occurrences"))


#: With this bound every term table is searched by its index.
INDEXED = Settings(dictionary_chars=1)


@query(PASSAGES)
def dictionary_company_terms(spark, folder):
    """The benchmark passages as company terms, searched in all documents."""
    return _passages(spark, folder, Settings())


@query(PASSAGES)
def dictionary_passage_index(spark, folder):
    """The same by the rare-gram index."""
    return _passages(spark, folder, INDEXED)


def _customer_roster(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pos"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("full_name"),
        F.lit(None).cast("string").alias("email"),
        F.concat(F.lit("cu"), F.col("c_custkey").cast("string"), F.lit("x")).alias("username"),
    )


def _order_notes(spark, folder):
    """Notes that name the customer of an order in capitals or by user name."""
    customer = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    named = F.concat(F.lit("handled for "), F.upper(F.concat_ws(" ", "c_mktsegment", "c_name")), F.lit(" at the desk"))
    user = F.concat(F.lit("entered by cu"), F.col("c_custkey").cast("string"), F.lit("x at the desk"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", user).otherwise(named).alias("text")
    )


ORDER_NOTES = """
    SELECT o_orderkey, c_custkey, CASE WHEN o_orderstatus = 'F' THEN 'entered by cu' || c_custkey || 'x at the desk'
      ELSE 'handled for ' || upper(c_mktsegment || ' ' || c_name) || ' at the desk' END AS text
    FROM orders JOIN customer ON o_custkey = c_custkey"""


NAMED = f"""
    WITH notes AS ({ORDER_NOTES}),
    terms AS (SELECT c_mktsegment || ' ' || c_name AS term FROM customer
              UNION SELECT 'cu' || c_custkey || 'x' FROM customer)
    SELECT o_orderkey, substr(text, strpos(lower(text), lower(term)), length(term)) AS value,
           CAST(strpos(lower(text), lower(term)) - 1 AS INTEGER) AS start_at
    FROM notes JOIN terms ON contains(lower(text), lower(term))"""


def _named(spark, folder, settings: Settings) -> DataFrame:
    dictionary = D.load(spark, settings.with_(roster=_customer_roster(spark, folder)))
    found = D.find(_order_notes(spark, folder), ["o_orderkey"], "text", dictionary)
    return DET.span_rows(found, ["o_orderkey"], "spans").select(
        "o_orderkey", "value", F.col("start").alias("start_at")
    )


@query(NAMED)
def dictionary_roster(spark, folder):
    return _named(spark, folder, Settings())


@query(NAMED)
def dictionary_roster_index(spark, folder):
    return _named(spark, folder, INDEXED)


@query(
    """
    WITH src AS (SELECT c_custkey, c_name || ' lives in ' || n_name || ', ' || r_name || '.' AS text
                 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    terms AS (SELECT n_name AS term FROM nation UNION SELECT r_name FROM region),
    found AS (SELECT c_custkey, term FROM src JOIN terms ON contains(text, term))
    SELECT c_custkey, 'LOC' AS etype, term AS value FROM found a
    WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.c_custkey = a.c_custkey AND b.term <> a.term
                      AND contains(b.term, a.term))"""
)
def lexicon_entities(spark, folder):
    """Places from a lexicon; of overlapping names the longest wins."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.select(F.col("n_name").alias("term")).union(region.select("r_name")).withColumn("etype", F.lit("LOC"))
    customer = table(spark, folder, "customer")
    src = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", F.concat("c_name", F.lit(" lives in "), "n_name", F.lit(", "), "r_name", F.lit(".")).alias("text"))
    )
    return _entity_rows(src, "c_custkey", Settings(lexicon=places)).select("c_custkey", "etype", "value")


# ---- policy ---------------------------------------------------------------------

EXCLUDED = ("233.233.171.252", "HEIN.19@MAIL5.EXAMPLE.COM", "+1 (310) 555-4510")
SUBJECT = {"email": "best.54@mail3.example.com", "phone": "+1 (523) 555-1055", "credit_card": "4316522678525456"}


def _lower_list(values) -> str:
    return "(" + ", ".join(lit(v.lower()) for v in values) + ")"


def _some_values(spark, folder, column: str) -> DataFrame:
    """A third of the e-mail addresses of the documents, in capitals."""
    found = _documents(spark, folder).select(F.expr(f"explode({SP.rule_spans('text', P.PATTERN_RULES['EMAIL'])})").alias("s"))
    value = F.upper("s.value")
    third = F.conv(F.substring(F.md5(F.lower("s.value")), 1, 2), 16, 10).cast("int") % 3 == 0
    return found.filter(third).select(value.alias(column)).distinct()


THIRD = "etype = 'EMAIL' AND CAST(('0x' || substr(md5(lower(value)), 1, 2)) AS INTEGER) % 3 = 0"


@query(
    "WITH " + settled("documents", "doc_id", "text", STANDARD_TIERS, entering=f"NOT ({THIRD} AND value = lower(value))")
    + f" SELECT doc_id, etype, value FROM ents WHERE NOT ({THIRD})"
)
def exclude_table(spark, folder):
    """Excluded terms as a table."""
    settings = Settings(exclude_terms=_some_values(spark, folder, "term"))
    return _entity_rows(_documents(spark, folder), "doc_id", settings).select("doc_id", "etype", "value")


@query(
    """
    WITH src AS (SELECT c_custkey, c_nationkey, c_mktsegment || ' ' || c_name AS full_name, c_name AS last FROM customer),
    spared AS (SELECT full_name AS v FROM src WHERE c_nationkey < 5),
    kept AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM src WHERE c_nationkey >= 5),
    ips AS (SELECT c_nationkey, row_number() OVER (ORDER BY min(c_custkey)) AS m FROM src GROUP BY 1)
    SELECT src.c_custkey, CASE WHEN n IS NULL THEN full_name ELSE '[PERSON_' || n || ']' END || ' was at [IP_' || m || ']' AS text
    FROM src LEFT JOIN kept USING (c_custkey) JOIN ips USING (c_nationkey)"""
)
def subject_names(spark, folder):
    """Everybody of some nations is a data subject: their names, from a table, stay visible."""
    customer = table(spark, folder, "customer")
    name = F.concat_ws(" ", "c_mktsegment", "c_name")
    subjects = customer.filter("c_nationkey < 5").select(F.upper(name).alias("full_name"))
    roster = customer.select(name.alias("term"), F.lit("PERSON").alias("etype"))
    text = F.concat(name, F.lit(" was at 10.0.0."), F.col("c_nationkey").cast("string"))
    settings = Settings(lexicon=roster, subject_values=SUB.subject_table(subjects))
    return jobs.pseudonymise_text(customer.select("c_custkey", text.alias("text")), "text", ["c_custkey"], settings).df


ENTERING = f"value NOT IN {_lower_list(EXCLUDED)}"


@query(
    "WITH " + settled("documents", "doc_id", "text", STANDARD_TIERS, entering=ENTERING)
    + f" SELECT doc_id, etype, value FROM ents WHERE lower(value) NOT IN {_lower_list(EXCLUDED)}"
)
def exclude_terms(spark, folder):
    """Spelled as excluded, a term does not even block what it overlaps."""
    settings = Settings(exclude_terms=EXCLUDED)
    return _entity_rows(_documents(spark, folder), "doc_id", settings).select("doc_id", "etype", "value")


@query(f"{ENTS} SELECT doc_id, etype, value FROM ents WHERE lower(value) NOT IN {_lower_list(SUBJECT.values())}")
def subject_exempt(spark, folder):
    settings = Settings(subject_values=tuple(SUBJECT.values()))
    return _entity_rows(_documents(spark, folder), "doc_id", settings).select("doc_id", "etype", "value")


@query(f"{ENTS} SELECT doc_id, etype, value FROM ents WHERE etype NOT IN ('IP', 'PHONE')")
def passthrough_strict(spark, folder):
    """E-mail addresses are protected, so asking for them has no effect."""
    types = passthrough_for_tokens(["IP", "EMAIL"], ["PHONE"])
    settings = Settings(passthrough_types=tuple(types))
    return _entity_rows(_documents(spark, folder), "doc_id", settings).select("doc_id", "etype", "value")


@query(f"{REDACT_ENTS} SELECT doc_id, etype, value FROM ents WHERE etype NOT IN ('IP', 'EMAIL')")
def passthrough_relaxed(spark, folder):
    """Only card numbers are protected here."""
    base = Settings(redact=True, redact_profiles={"share": {"passthrough": ["ip", "credit_card"]}})
    settings = base.with_(passthrough_types=tuple(passthrough_for_redact(base, "share", ["email"])))
    return _entity_rows(_documents(spark, folder), "doc_id", settings).select("doc_id", "etype", "value")


# ---- registry -------------------------------------------------------------------


def _registry_events(df: DataFrame, key: str, settings: Settings) -> DataFrame:
    rows = _entity_rows(df, key, settings).withColumn("ord", F.struct(F.col(key).alias("o0")))
    return E.from_spans(rows, settings.active_masks)


@query(f"{ENTS}, {numbered('ents', 'doc_id, rnk')} SELECT value, etype, token FROM reg")
def registry_tokens(spark, folder):
    events = _registry_events(_documents(spark, folder), "doc_id", Settings())
    return REG.build(events).select("value", "etype", "token")


def _person_events(spark, folder) -> DataFrame:
    """Names made of segment and nation, some of one word only, in customer order."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    name = F.when(F.col("c_acctbal") < 0, F.col("n_name")).otherwise(F.concat_ws(" ", "c_mktsegment", "n_name"))
    order = F.struct(F.col("c_custkey").alias("o0"))
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        name.alias("value"), F.lit("PERSON").alias("etype"), F.lit(E.PERSON).alias("kind"),
        F.lit(None).cast("string").alias("anchor"), E.seq(F.lit(0), order, F.lit(0), F.lit(0)).alias("seq"),
    )


PERSON_WINNERS = """
    WITH base AS (
      SELECT CASE WHEN c_acctbal < 0 THEN n_name ELSE c_mktsegment || ' ' || n_name END AS value, min(c_custkey) AS k
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    events AS (
      SELECT value, k, 0 AS sub FROM base
      UNION ALL SELECT split_part(value, ' ', 1), k, 1 FROM base WHERE contains(value, ' ')
      UNION ALL SELECT split_part(value, ' ', 2), k, 2 FROM base WHERE contains(value, ' ')),
    won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY k, sub) AS nth FROM events)
            WHERE nth = 1),
    persons AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM won WHERE sub = 0)"""


@query(
    PERSON_WINNERS
    + """
    SELECT value, '[PERSON_' || n || CASE sub WHEN 0 THEN '' WHEN 1 THEN '_FIRST' ELSE '_LAST' END || ']' AS token
    FROM won JOIN persons USING (k)"""
)
def registry_person_surface(spark, folder):
    return REG.build(_person_events(spark, folder)).select("value", "token")


@query(
    PERSON_WINNERS
    + """
    SELECT value, n || '_' || upper(substr(value, 1, 1)) || '.' ||
           CASE WHEN contains(value, ' ') THEN upper(substr(split_part(value, ' ', 2), 1, 1)) || '.' ELSE '' END AS token,
           FALSE AS restorable
    FROM won JOIN persons USING (k)"""
)
def person_mask(spark, folder):
    return REG.build(_person_events(spark, folder), P.MASK_DEFAULTS).select("value", "token", "restorable")


@query(
    f"""{ENTS}, cards AS (SELECT DISTINCT value, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ents
                          WHERE etype = 'CREDIT_CARD')
    SELECT value, substr(d, 1, 6) || repeat('X', length(d) - 10) || right(d, 4) AS token,
           substr(d, 1, 4) || repeat('*', length(d) - 8) || right(d, 4) AS token44 FROM cards"""
)
def card_mask(spark, folder):
    settings = Settings(mask=True, masking_rules=P.MASK_DEFAULTS)
    events = _registry_events(_documents(spark, folder), "doc_id", settings)
    cards = REG.build(events, settings.active_masks).filter(F.col("kind") == E.CARD)
    other = S.card_mask(F.col("value"), {"keep_first": 4, "fill_char": "*"})
    return cards.select("value", "token", other.alias("token44"))


@query(
    f"""{ENTS}, placed AS (SELECT ents.*, CAST(lang <> 'en' AS INTEGER) AS batch
                           FROM ents JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
    {numbered('placed', 'batch, doc_id, rnk')} SELECT value, token, batch FROM reg"""
)
def registry_continue(spark, folder):
    """English documents first, the others continue their registry."""
    docs = table(spark, folder, "documents")
    english = F.col("lang") == "en"
    first = REG.build(_registry_events(docs.filter(english).select("doc_id", "text"), "doc_id", Settings()))
    rest = _registry_events(docs.filter(~english).select("doc_id", "text"), "doc_id", Settings())
    second = REG.build(rest, previous=first)
    return first.unionByName(second).select("value", "token", "batch")


def _two_rosters(spark, folder):
    base = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row"),
        F.concat(F.lit("Agent "), F.col("c_nationkey").cast("string"), F.lit(" "), "c_mktsegment").alias(" Full_Name "),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("USERNAME"),
    )
    extra = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("row"),
        F.concat(F.lit(" Agent "), F.col("s_nationkey").cast("string"), F.lit(" MACHINERY ")).alias("full_name"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("username"),
    )
    return ROS.normalise(base, "row"), ROS.normalise(extra, "row")


@query(
    """
    WITH rosters AS (
      SELECT 0 AS source, c_custkey AS pos, 'Agent ' || c_nationkey || ' ' || c_mktsegment AS full_name,
             'c' || c_custkey AS username FROM customer
      UNION ALL SELECT 1, s_suppkey, 'Agent ' || s_nationkey || ' MACHINERY', 's' || s_suppkey FROM supplier),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY source, pos) AS first_nth,
               row_number() OVER (PARTITION BY full_name ORDER BY source DESC, pos DESC) AS last_nth FROM rosters)
    SELECT f.full_name, f.source, f.pos, l.username FROM ranked f JOIN ranked l USING (full_name)
    WHERE f.first_nth = 1 AND l.last_nth = 1"""
)
def roster_merge(spark, folder):
    return ROS.merge(*_two_rosters(spark, folder)).select("full_name", "source", "pos", "username")


@query(
    f"""
    WITH people AS (SELECT c_custkey, c_mktsegment AS seg, c_name, c_mktsegment || ' ' || c_name AS full_name,
                           row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
    seen AS (SELECT c_custkey, min(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey
             WHERE o_orderstatus <> 'F' GROUP BY 1),
    fresh AS (SELECT upper(full_name) AS value, upper(c_name) AS last_word,
                     (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY k) AS n
              FROM seen JOIN people USING (c_custkey))
    SELECT full_name AS value, '[PERSON_' || n || ']' AS token FROM people
    UNION ALL SELECT seg, '[PERSON_' || min(n) || '_FIRST]' FROM people GROUP BY seg
    UNION ALL SELECT c_name, '[PERSON_' || n || '_LAST]' FROM people
    UNION ALL SELECT 'cu' || c_custkey || 'x', '[PERSON_' || n || ']' FROM people
    UNION ALL SELECT value, '[PERSON_' || n || ']' FROM fresh
    UNION ALL SELECT last_word, '[PERSON_' || n || '_LAST]' FROM fresh"""
)
def roster_preregister(spark, folder):
    """The roster takes the first numbers; names written differently in the notes follow."""
    settings = Settings(roster=_customer_roster(spark, folder))
    result = jobs.pseudonymise_text(_order_notes(spark, folder), "text", ["o_orderkey"], settings)
    return REG.forward(result.registry)


# ---- structured -----------------------------------------------------------------


@query(
    """
    WITH firsts AS (SELECT user_id, row_number() OVER (ORDER BY t, e) AS n FROM (
      SELECT user_id, ts AS t, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth
      FROM events) WHERE nth = 1)
    SELECT event_id, '[PERSON_' || n || ']' AS user_id, event_type FROM events JOIN firsts USING (user_id)"""
)
def anchor_tokens(spark, folder):
    events = table(spark, folder, "events")
    result = jobs.pseudonymise_table(events, ["event_id"], order_by=["ts", "event_id"], scan=["event_type", "props"])
    return result.df.select("event_id", "user_id", "event_type")


def _order_contacts(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    k = F.col("c_custkey").cast("string")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", F.col("c_name").alias("name"),
        F.concat(F.lit("c"), k, F.lit("@shop"), F.col("c_nationkey").cast("string"), F.lit(".example.com")).alias("email"),
        F.concat(F.lit("cust-"), k).alias("login"),
    )


def _correlated_sql(column: str) -> str:
    return f"""
    WITH firsts AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) AS n
                    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)
    SELECT o_orderkey, '[PERSON_' || n || ']' AS name, {column} FROM orders JOIN firsts USING (o_custkey)"""


@query(_correlated_sql("'[EMAIL_PERSON_' || n || ']' AS email"))
def correlated_email(spark, folder):
    settings = Settings(anchor_field="name", correlated_fields=("email",))
    contacts = _order_contacts(spark, folder).select("o_orderkey", "name", "email")
    return jobs.pseudonymise_table(contacts, ["o_orderkey"], settings, scan=[]).df


@query(_correlated_sql("'[PERSON_' || n || ']' AS login"))
def correlated_alias(spark, folder):
    settings = Settings(anchor_field="name", correlated_fields=("login",))
    contacts = _order_contacts(spark, folder).select("o_orderkey", "name", "login")
    return jobs.pseudonymise_table(contacts, ["o_orderkey"], settings, scan=[]).df


CHAIN = 2500


@query(
    f"""
    WITH src AS (SELECT event_id, event_id // {CHAIN} AS c FROM events),
    n AS (SELECT c, row_number() OVER (ORDER BY c) AS n FROM src GROUP BY c)
    SELECT event_id, '[PERSON_' || n || ']' AS badge, '[PERSON_' || n || ']' AS next_badge FROM src JOIN n USING (c)"""
)
def alias_chain(spark, folder):
    """Every row ties the next row's badge to its own: chains of thousands of links share one token."""
    k = F.col("event_id")
    last = (k + 1) % CHAIN == 0
    src = table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("v"), k.cast("string")).alias("badge"),
        F.when(last, F.concat(F.lit("end"), k.cast("string"))).otherwise(F.concat(F.lit("v"), (k + 1).cast("string"))).alias("next_badge"),
    )
    settings = Settings(anchor_field="badge", correlated_fields=("next_badge",))
    return jobs.pseudonymise_table(src, ["event_id"], settings, scan=[]).df


@query(
    """
    WITH src AS (SELECT event_id AS k, CASE WHEN value < 10 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS anchor,
                        'u' || user_id || '@site.example.com' AS email, 'user' || user_id AS login FROM events),
    ev AS (
      SELECT anchor AS value, 'person' AS kind, 'PERSON' AS etype, anchor, k, 0 AS c FROM src WHERE anchor IS NOT NULL
      UNION ALL SELECT email, CASE WHEN anchor IS NULL THEN 'token' ELSE 'email_of' END, 'EMAIL', anchor, k, 1 FROM src
      UNION ALL SELECT login, CASE WHEN anchor IS NULL THEN 'plain' ELSE 'alias_of' END, 'PERSON', anchor, k, 2 FROM src),
    won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY k, c) AS nth FROM ev) WHERE nth = 1),
    num AS (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY k, c) AS n FROM won
            WHERE kind IN ('person', 'plain', 'token')),
    reg AS (
      SELECT value, '[' || etype || '_' || n || ']' AS token FROM num
      UNION ALL SELECT w.value, CASE WHEN w.kind = 'email_of' THEN '[EMAIL_PERSON_' || a.n || ']'
                                ELSE '[PERSON_' || a.n || ']' END
      FROM won w JOIN num a ON a.value = w.anchor WHERE w.kind IN ('email_of', 'alias_of'))
    SELECT s.k AS event_id, coalesce(a.token, '') AS user_id, e.token AS email, l.token AS login
    FROM src s LEFT JOIN reg a ON a.value = s.anchor JOIN reg e ON e.value = s.email JOIN reg l ON l.value = s.login"""
)
def null_anchor_rows(spark, folder):
    """Rows without an anchor register their correlated cells on their own."""
    user = F.col("user_id").cast("string")
    src = table(spark, folder, "events").select(
        "event_id", F.when(F.col("value") < 10, F.lit(" NaN ")).otherwise(user).alias("user_id"),
        F.concat(F.lit("u"), user, F.lit("@site.example.com")).alias("email"),
        F.concat(F.lit("user"), user).alias("login"),
    )
    settings = Settings(correlated_fields=("email", "login"))
    out = jobs.pseudonymise_table(src, ["event_id"], settings, scan=[]).df
    return out.withColumn("user_id", F.when(F.col("user_id") == " NaN ", "").otherwise(F.col("user_id")))


@query(
    """
    WITH src AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
    ips AS (SELECT c_nationkey, row_number() OVER (ORDER BY min(c_custkey)) AS m FROM customer GROUP BY c_nationkey)
    SELECT c_custkey, '[PERSON_' || n || ']' AS c_name, 'mail [EMAIL_' || n || '] from [IP_' || m || ']' AS contact
    FROM src JOIN ips USING (c_nationkey)"""
)
def no_anchor_cells(spark, folder):
    """No anchor column: cells are detected, the forced one is replaced whole."""
    contact = F.concat(
        F.lit("mail c"), F.col("c_custkey").cast("string"), F.lit("@x.example.com from 10.0."),
        F.col("c_nationkey").cast("string"), F.lit(".7"),
    )
    src = table(spark, folder, "customer").select("c_custkey", "c_name", contact.alias("contact"))
    job = jobs.pseudonymise_table(src, ["c_custkey"], force_fields=["c_name"], scan=["contact"])
    return job.df


@query(
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 1000
      THEN '[EMAIL_' || row_number() OVER (PARTITION BY c_acctbal < 1000 ORDER BY c_custkey) || ']'
      ELSE '[PERSON_' || row_number() OVER (PARTITION BY c_acctbal < 1000 ORDER BY c_custkey) || ']' END AS login
    FROM customer"""
)
def force_fields(spark, folder):
    login = F.when(F.col("c_acctbal") < 1000, F.concat("c_name", F.lit("@x"))).otherwise(F.col("c_name"))
    src = table(spark, folder, "customer").select("c_custkey", login.alias("login"))
    return jobs.pseudonymise_table(src, ["c_custkey"], Settings(force_fields=("login",))).df


@query(
    """
    WITH src AS (SELECT s_suppkey, s_acctbal < 2000 AS short, s_acctbal >= 8000 AS none FROM supplier),
    num AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM src WHERE NOT none)
    SELECT s_suppkey, CASE WHEN none THEN 'nothing to see' WHEN short THEN '[PERSON_' || n || ']'
      ELSE 'the desk asked [PERSON_' || n || '] for an answer' END AS note
    FROM src LEFT JOIN num USING (s_suppkey)"""
)
def cell_person_70(spark, folder):
    """Cells mostly made of a known name become one person, others are rewritten inside."""
    supplier = table(spark, folder, "supplier")
    names = supplier.select(F.col("s_name").alias("term"), F.lit("PERSON").alias("etype"))
    note = (
        F.when(F.col("s_acctbal") < 2000, F.concat(F.col("s_name"), F.lit(", Mr")))
        .when(F.col("s_acctbal") >= 8000, "nothing to see")
        .otherwise(F.concat(F.lit("the desk asked "), "s_name", F.lit(" for an answer")))
    )
    src = supplier.select("s_suppkey", note.alias("note"))
    return jobs.pseudonymise_table(src, ["s_suppkey"], Settings(lexicon=names), scan=["note"]).df


@query(
    """
    WITH ev AS (
      SELECT c_name AS value, 0 AS src, c_custkey AS k FROM customer
      UNION ALL SELECT c_name, 1, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT s_name, 2, s_suppkey FROM supplier),
    reg AS (SELECT value, row_number() OVER (ORDER BY src, k) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY value ORDER BY src, k) AS nth FROM ev) WHERE nth = 1)
    SELECT CASE src WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' ELSE 'supplier' END AS source, k,
           '[PERSON_' || n || ']' AS full_name FROM ev JOIN reg USING (value)"""
)
def multi_table_registry(spark, folder):
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    supplier = table(spark, folder, "supplier")
    tables = {
        "customer": customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("full_name")),
        "orders": orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            F.col("o_orderkey").alias("k"), F.col("c_name").alias("full_name")
        ),
        "supplier": supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("full_name")),
    }
    result = jobs.pseudonymise_tables({n: jobs.TableInput(t, ["k"], scan=[]) for n, t in tables.items()})
    parts = [t.select(F.lit(n).alias("source"), "k", "full_name") for n, t in result.outputs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """
    WITH src AS (SELECT CASE WHEN value < 10 THEN NULL ELSE user_id END AS anchor, event_type, user_id % 7 AS team FROM events),
    long AS (SELECT anchor, 'event_type' AS field, event_type AS v FROM src UNION ALL SELECT anchor, 'team', 't' || team FROM src),
    per AS (SELECT field, v, count(*) AS n, count(*) - count(anchor) AS alone, count(DISTINCT anchor) AS anchors FROM long GROUP BY ALL)
    SELECT field, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(alone) AS BIGINT) AS without_anchor,
      CAST(count_if(anchors > 0) AS BIGINT) AS "values", CAST(count_if(anchors > 1) AS BIGINT) AS shared_values, max(anchors) AS most_anchors
    FROM per GROUP BY field"""
)
def anchor_profile(spark, folder):
    """Would the user id do as an anchor of event types and teams?"""
    events = table(spark, folder, "events").select(
        F.when(F.col("value") >= 10, F.col("user_id")).alias("user_id"), "event_type",
        F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("team"),
    )
    return PRO.anchor_profile(events, "user_id", ["event_type", "team"])


@query(
    """
    WITH src AS (SELECT event_id AS k, user_id, 'u' || user_id || '@x.example.com' AS mail, props FROM events),
    n AS (SELECT user_id, row_number() OVER (ORDER BY min(k)) AS n FROM src GROUP BY 1)
    SELECT k AS event_id, '[PERSON_' || n || ']' AS user_id, '[EMAIL_' || n || '] ' || props AS props FROM src JOIN n USING (user_id)"""
)
def anchored_cells(spark, folder):
    """The other columns of an anchored table are searched, nested text included."""
    src = table(spark, folder, "events").select(
        "event_id", "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.example.com "), "props").alias("props")
    )
    return jobs.pseudonymise_table(src, ["event_id"], scan=["props"]).df


@query(
    """
    WITH src AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n,
                   row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS m, c_acctbal < 0 AS low FROM customer)
    SELECT c_custkey, n || '_C.' AS name, 'card 411111XXXXXX1111' || CASE WHEN low THEN ' owes [AMOUNT_' || m || ']' ELSE '' END AS note FROM src"""
)
def redact_people(spark, folder):
    """One-way redaction of a table: names and cards masked, amounts found as well."""
    owes = F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" owes $"), F.col("c_custkey").cast("string"))).otherwise(F.lit(""))
    note = F.concat(F.lit("card 4111 1111 1111 1111"), owes)
    src = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"), note.alias("note"))
    return jobs.redact_table(src, ["c_custkey"], scan=["note"])


@query(
    """
    WITH base AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
    SELECT c_custkey, 'seen: [PERSON_' || n || '] and [EMAIL_' || n || ']' AS text FROM base"""
)
def model_names(spark, folder):
    """A model of the user's own finds the names."""
    customer = table(spark, folder, "customer")
    mail = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.example.com"))
    src = customer.select("c_custkey", F.concat(F.lit("seen: "), "c_name", F.lit(" and "), mail).alias("text"))
    model = lambda c: F.expr(SP.as_spans(SP.find_all("text", SP.lit("Customer#[0-9]+")), "'PERSON'", "0.85"))
    return jobs.pseudonymise_text(src, "text", ["c_custkey"], Settings(ner=model)).df


@query(
    f"""{ENTS}, {numbered('ents', 'doc_id, rnk')}
    SELECT DISTINCT ents.doc_id, ents.value FROM ents"""
)
def own_values(spark, folder):
    """The audit of each text for its own values, on the texts as they were."""
    docs = _documents(spark, folder)
    run = jobs.pseudonymise_text(docs, "text", ["doc_id"])
    return jobs.audit(docs, "text", ["doc_id"], run.registry, hits=run.only_hits)


# ---- rewriting, restoring, auditing ---------------------------------------------

PAIRS = f"{numbered('ents', 'doc_id, rnk')}, pairs AS (SELECT ents.doc_id, ents.value, reg.token FROM ents JOIN reg USING (value))"


@query(f"{ENTS}, {PAIRS} {rewritten('documents', 'doc_id', 'text', 'pairs')}")
def redact_text(spark, folder):
    return jobs.pseudonymise_text(_documents(spark, folder), "text", ["doc_id"]).df


@query(f"{ENTS}, {PAIRS} {rewritten('documents', 'doc_id', 'text', 'pairs')}")
def redact_text_shuffled(spark, folder):
    """The same with nothing broadcast: texts with spans meet their maps in a shuffle, others pass by."""
    settings = Settings(broadcast_bytes=0)
    return jobs.pseudonymise_text(_documents(spark, folder), "text", ["doc_id"], settings).df


@query(
    """
    WITH src AS (SELECT conv_id, turn, text || ' reach me at u' || conv_id || '@chat.example.com or 555-'
                 || lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') || '-1234' AS text FROM conversations),
    mails AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS n FROM conversations GROUP BY conv_id),
    phones AS (SELECT lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') AS p, row_number() OVER (ORDER BY min(conv_id)) AS m
               FROM conversations GROUP BY 1)
    SELECT conv_id, turn, replace(replace(text, 'u' || conv_id || '@chat.example.com', '[EMAIL_' || n || ']'),
           '555-' || p || '-1234', '[PHONE_' || m || ']') AS text
    FROM src JOIN mails USING (conv_id) JOIN phones ON p = lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0')"""
)
def redact_paragraphs(spark, folder):
    """Turns are the paragraphs of a conversation."""
    conv = F.col("conv_id").cast("string")
    text = F.concat(
        "text", F.lit(" reach me at u"), conv, F.lit("@chat.example.com or 555-"),
        F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"), F.lit("-1234"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", text.alias("text"))
    return jobs.pseudonymise_text(turns, "text", ["conv_id", "turn"], document=["conv_id"]).df


@query(
    """
    WITH p AS (SELECT conv_id, lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') AS p, min(conv_id) OVER (PARTITION BY conv_id % 1000) AS f
               FROM conversations GROUP BY conv_id),
    m AS (SELECT p, row_number() OVER (ORDER BY min(f)) AS m FROM p GROUP BY p)
    SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'call [PHONE_' || m || ']' ELSE 'ref x5[PHONE_' || m || ']9' END AS text
    FROM conversations JOIN p USING (conv_id) JOIN m USING (p)"""
)
def paragraphs_share(spark, folder):
    """A number found in the first turn is replaced in the others too, where nothing would find it."""
    number = F.concat(F.lit("555-"), F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"), F.lit("-1234"))
    text = F.when(F.col("turn") == 0, F.concat(F.lit("call "), number)).otherwise(F.concat(F.lit("ref x5"), number, F.lit("9")))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", text.alias("text"))
    return jobs.pseudonymise_text(turns, "text", ["conv_id", "turn"], document=["conv_id"]).df


@query("SELECT doc_id, text FROM documents")
def restore_roundtrip(spark, folder):
    result = jobs.pseudonymise_text(_documents(spark, folder), "text", ["doc_id"])
    return jobs.restore(result.df, ["text"], result.registry, ["doc_id"])


def _clients(spark, folder):
    """Three text columns: an anchor, a correlated address, and notes of which some have nothing to hide."""
    k = F.col("c_custkey").cast("string")
    note = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("seen at 10.1."), F.col("c_nationkey").cast("string"), F.lit(".9"))).otherwise(F.col("c_mktsegment"))
    return table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("c"), k, F.lit("@x.example.com")).alias("email"), note.alias("note"), "c_acctbal"
    )


@query(
    """
    SELECT c_custkey, c_name AS name, 'c' || c_custkey || '@x.example.com' AS email,
      CASE WHEN c_acctbal < 0 THEN 'seen at 10.1.' || c_nationkey || '.9' ELSE c_mktsegment END AS note, c_acctbal
    FROM customer"""
)
def restore_table(spark, folder):
    """A table with tokens in several columns, restored; the registry is too large to broadcast."""
    settings = Settings(correlated_fields=("email",))
    done = jobs.pseudonymise_table(_clients(spark, folder), ["c_custkey"], settings, scan=["note"])
    return RES.restore(done.df, ["name", "email", "note"], done.registry, bound=0)


@query(
    """
    WITH base AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
    SELECT c_custkey, 'see **' || c_name || '** and `' || c_name || '` not [PERSON_' || n || '_X] [PERSON ' || n || ']' AS text
    FROM base"""
)
def restore_case_variants(spark, folder):
    """Tokens come back in any case and inside other markup; unknown ones stay."""
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"))
    result = jobs.pseudonymise_table(customer, ["c_custkey"], scan=[])
    token = F.col("name")
    unknown = F.regexp_replace(token, r"\]$", "_X]")
    spaced = F.translate(token, "_", " ")
    text = F.concat(
        F.lit("see **"), F.lower(token), F.lit("** and `"), token, F.lit("` not "), unknown, F.lit(" "), spaced
    )
    texts = result.df.select("c_custkey", text.alias("text"))
    return jobs.restore(texts, ["text"], result.registry, ["c_custkey"])


LEAKS = f"""{ENTS}, {PAIRS}, after AS ({rewritten('documents', 'doc_id', 'text', 'pairs')}),
    vals AS (SELECT DISTINCT value FROM ents)
    SELECT 'before' AS stage, count(*) AS leaks FROM documents JOIN vals ON contains(text, value)
    UNION ALL SELECT 'after', count(*) FROM after JOIN vals ON contains(text, value)"""


def _leaks(spark, folder, settings: Settings) -> DataFrame:
    docs = _documents(spark, folder)
    result = jobs.pseudonymise_text(docs, "text", ["doc_id"])
    counts = [
        jobs.audit(texts, "text", ["doc_id"], result.registry, settings)
        .agg(F.count(F.lit(1)).alias("leaks"))
        .select(F.lit(stage).alias("stage"), "leaks")
        for stage, texts in (("before", docs), ("after", result.df))
    ]
    return counts[0].unionByName(counts[1])


@query(LEAKS)
def leak_audit(spark, folder):
    """Visible registered values before and after; the second count must be zero."""
    return _leaks(spark, folder, Settings())


@query(LEAKS)
def leak_audit_index(spark, folder):
    """The same by the rare-gram index, as with a registry of any size."""
    return _leaks(spark, folder, INDEXED)


@query(
    f"""{ENTS}, kept AS (SELECT * FROM ents WHERE lower(value) NOT IN {_lower_list(SUBJECT.values())}),
    {numbered('kept', 'doc_id, rnk')},
    pairs AS (SELECT kept.doc_id, kept.value, CASE WHEN reg.etype = 'CREDIT_CARD'
                THEN substr(value, 1, 6) || repeat('X', length(value) - 10) || right(value, 4) ELSE reg.token END AS token
              FROM kept JOIN reg USING (value))
    {rewritten('documents', 'doc_id', 'text', 'pairs')}"""
)
def dsar_documents(spark, folder):
    return jobs.dsar_text(_documents(spark, folder), "text", ["doc_id"], SUBJECT)


@query(
    f"""{ENTS} SELECT coalesce(lang, 'all') AS lang, coalesce(etype, 'all') AS etype, count(*) AS spans,
    count(DISTINCT value) AS distinct_values, count(DISTINCT doc_id) AS documents
    FROM ents JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP(lang, etype)"""
)
def findings_rollup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    settings = Settings()
    rows = DET.span_rows(DET.detect(docs, "text", ["doc_id", "lang"], settings), ["doc_id", "lang"])
    out = SUM.findings(rows, "lang", "doc_id")
    return out.select(
        F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("etype", F.lit("all")).alias("etype"),
        "spans", "distinct_values", "documents",
    )
