"""Rosters of known people: normalising, merging, registering ahead of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilmark.functions import scalars as S
from veilmark.operators import events as E
from veilmark.operators.common import cut


class RosterError(ValueError):
    pass


def normalise(raw: DataFrame, pos: str | None = None) -> DataFrame:
    """Raw columns -> ``(pos, full_name, email, username)``.

    Header names are trimmed and lower-cased, blanks become NULL and rows without a name
    are dropped.  *pos* names a column that gives the order of the rows; without it the
    order of the names decides.
    """
    by_name = {c.strip().lower(): c for c in raw.columns}
    if "full_name" not in by_name:
        raise RosterError(f"a roster needs a 'full_name' column (found: {raw.columns})")

    def field(name: str):
        if name not in by_name:
            return F.lit(None).cast("string").alias(name)
        return F.nullif(S.strip(F.col(f"`{by_name[name]}`").cast("string")), F.lit("")).alias(name)

    order = F.col(pos).cast("bigint").alias("pos") if pos else F.lit(None).cast("bigint").alias("pos")
    return raw.select(order, *[field(c) for c in ("full_name", "email", "username")]).filter(
        F.col("full_name").isNotNull()
    )


def merge(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Union by ``full_name``: the later record wins whole, the earlier position stays."""
    both = base.withColumn("source", F.lit(0)).unionByName(extra.withColumn("source", F.lit(1)))
    record = F.struct("email", "username")
    place = F.struct("source", "pos")
    merged = both.groupBy("full_name").agg(
        F.min(place).alias("first"), F.max_by(record, place).alias("last")
    )
    return merged.select(
        F.col("first.source").alias("source"), F.col("first.pos").alias("pos"),
        "full_name", "last.email", "last.username",
    )


def _source(roster: DataFrame):
    return F.col("source") if "source" in roster.columns else F.lit(0)


def placed(roster: DataFrame) -> DataFrame:
    """``source, pos, full_name, email, username`` with a position of its own for every entry.

    Entries follow each other by source, position and name; missing columns count as NULL
    and entries without a position come last.  Ids grow along a global sort.
    """
    kinds = {"source": "bigint", "pos": "bigint", "full_name": "string", "email": "string", "username": "string"}
    whole = roster.select(
        *[(F.col(c) if c in roster.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    ).withColumn("source", F.coalesce("source", F.lit(0)))
    ordered = whole.orderBy("source", F.col("pos").asc_nulls_last(), "full_name", "username")
    return cut(ordered.withColumn("pos", F.monotonically_increasing_id()))


def events(roster: DataFrame, order: StructType) -> DataFrame:
    """Phase-0 events of a placed roster: each full name, then its user name as an alias of it."""
    name, user = S.strip(F.col("full_name")), F.nullif(S.strip(F.col("username")), F.lit(""))
    nothing = F.lit(None).cast(order)
    # Two rosters never share a position: the source goes into the high digits.
    src = _source(roster).cast("bigint") * F.lit(1 << 48) + F.col("pos")

    def event(value, kind, anchor, rank):
        return F.struct(
            value.alias("value"), F.lit("PERSON").alias("etype"), F.lit(kind).alias("kind"),
            anchor.cast("string").alias("anchor"),
            E.seq(src, nothing, F.lit(0), F.lit(rank), phase=0).alias("seq"),
        )

    both = F.array(event(name, E.PERSON, F.lit(None), 0), event(user, E.ALIAS, name, 1))
    return roster.select(F.inline(both)).filter(F.coalesce(F.col("value"), F.lit("")) != "")


def usernames(roster: DataFrame) -> DataFrame:
    """``(pos, full_name, username)`` of the entries that have a user name."""
    place = F.struct(_source(roster).alias("source"), F.col("pos"))
    return roster.select(
        place.alias("pos"), S.strip(F.col("full_name")).alias("full_name"),
        F.nullif(S.strip(F.col("username")), F.lit("")).alias("username"),
    ).filter(F.col("username").isNotNull())


def username_conflicts(roster: DataFrame) -> DataFrame:
    """User names that equal another entry's name, name part or user name.

    Overwriting such values is ambiguous, so callers should look at these first.
    """
    entry = F.struct(_source(roster), F.col("pos"), F.col("full_name"))
    name = F.col("full_name")
    terms = roster.select(
        entry.alias("entry"),
        F.explode(F.array_distinct(F.array(name, S.first_word(name), S.last_word(name), F.col("username")))).alias(
            "username"
        ),
    )
    users = usernames(roster.withColumn("entry", entry)).select("username")
    return (
        terms.filter(F.col("username").isNotNull())
        .join(users.distinct(), "username", "left_semi")
        .groupBy("username")
        .agg(F.count_distinct("entry").alias("entries"))
        .filter(F.col("entries") > 1)
    )
