"""The registry: one row per value with its token, built without visiting rows in turn.

The rule "first registration wins, then numbers count up per type" is stated as three
set operations: earliest event per value, name parts derived from new full names, and a
running count over the winners.  Values are reduced on the map side before each shuffle,
so a value that fills a third of the input costs no more than a rare one.

Columns: ``value, etype, token, kind, n, restorable, active, batch, seq``.  Rows with
``active = false`` were overwritten by a roster user name; they still restore.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import scalars as S
from veilmark.operators import events as E
from veilmark.operators.common import cut, stage

COLUMNS = ["value", "etype", "token", "kind", "n", "restorable", "active", "batch", "seq"]
NUMBERED = (E.PERSON, E.PLAIN, E.TOKEN)


class AliasDepthError(RuntimeError):
    pass


@dataclass(frozen=True)
class Previous:
    """What a run needs of an earlier registry: the rows of its values, the highest number per type, the last batch."""

    rows: DataFrame
    tops: DataFrame
    batch: int


def tops(registry: DataFrame) -> DataFrame:
    """``etype, top``: the highest number of each type."""
    return registry.filter(F.col("kind").isin(*NUMBERED)).groupBy("etype").agg(F.max("n").alias("top"))


def whole(registry: DataFrame) -> Previous:
    """An earlier registry that is read as a whole."""
    return Previous(registry, tops(registry), registry.agg(F.max("batch")).first()[0] or 0)


def earliest(events: DataFrame) -> DataFrame:
    """The first event of every value."""
    event = F.struct("etype", "kind", "anchor", "seq")
    return events.groupBy("value").agg(F.min_by(event, "seq").alias("e")).select("value", "e.*")


def name_parts(people: DataFrame) -> DataFrame:
    """First and last words of new full names, as events right after their person."""

    def part(value: Column, kind: str, sub: int) -> Column:
        return F.struct(
            value.alias("value"),
            F.lit("PERSON").alias("etype"),
            F.lit(kind).alias("kind"),
            F.col("value").alias("anchor"),
            F.col("seq").withField("sub", F.lit(sub)).alias("seq"),
        )

    name = F.col("value")
    new = (F.col("kind") == E.PERSON) & S.is_multi_word(name)
    parts = F.array(part(S.first_word(name), E.FIRST, 1), part(S.last_word(name), E.LAST, 2))
    return people.filter(new).select(F.inline(parts))


def winners(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The event that decides each value; values of an earlier registry are left out.

    A name part is one word, so it can never displace a full name: full names are settled
    by the first pass, and the second pass settles everything else.
    """

    def unknown(df: DataFrame) -> DataFrame:
        return df if known is None else df.join(known.select("value"), "value", "left_anti")

    # Used twice; without the cut the name filter would go down to the events and read them again.
    first = stage(unknown(earliest(events)))
    return earliest(first.unionByName(unknown(name_parts(first))))


def _counts() -> Column:
    return F.when(F.col("kind").isin(*NUMBERED), 1).otherwise(0).cast("bigint")


def number(rows: DataFrame, bound: int, single_task_rows: int = 1_000_000) -> DataFrame:
    """Add ``n``: the running count of numbered kinds per type.

    A name part sits right behind its person in ``seq``, so the running count gives it the
    person's number.  There are only about ten types; when *bound*, an upper limit of the
    row count, is too much for one task per type, the rows are range-partitioned on
    ``(etype, seq)`` and each range adds the totals of the ranges before it.
    """
    running = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if bound <= single_task_rows:
        return rows.withColumn("n", F.sum(_counts()).over(running.partitionBy("etype")))

    n_ranges = math.ceil(bound / single_task_rows) * 2
    # The range of a row must not change between the two uses below, hence the cut.
    ranged = cut(
        rows.repartitionByRange(n_ranges, "etype", "seq").withColumn("range", F.spark_partition_id())
    )
    before = Window.partitionBy("etype").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("etype", "range")
        .agg(F.sum(_counts()).alias("total"))
        .withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .select("etype", "range", "base")
    )
    # At most one row per type and range.
    placed = ranged.join(F.broadcast(totals), ["etype", "range"])
    local = F.sum(_counts()).over(running.partitionBy("etype", "range"))
    return placed.withColumn("n", F.col("base") + local).drop("range", "base")


def tokens(masks: dict) -> Column:
    """Token or mask of a numbered row; NULL for rows that follow another value."""
    kind, value, n = F.col("kind"), F.col("value"), F.col("n")
    n_text = n.cast("string")
    if "PERSON" in masks:
        person = F.concat(n_text, F.lit("_"), S.initials(value))
        part = F.concat(n_text, F.lit("_"), F.upper(F.substring(value, 1, 1)), F.lit("."))
    else:
        person = S.token(F.col("etype"), n)
        part = S.surface_token(n, kind)
    return (
        F.when(kind == E.PERSON, person)
        .when(kind.isin(E.PLAIN, E.TOKEN), S.token(F.col("etype"), n))
        .when(kind.isin(E.FIRST, E.LAST), part)
        .when(kind == E.CARD, S.card_mask(value, masks.get("CREDIT_CARD")))
    )


def _follow(anchor_token: Column, mail: Column) -> Column:
    """What a linked value becomes, given the token at the end of its chain; *mail*: an e-mail is on the way."""
    n = S.person_number(anchor_token)
    return F.when(mail & n.isNotNull(), S.email_token(n)).otherwise(anchor_token)


def link(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Resolve aliases and correlated e-mails through their anchors.

    An anchor may itself be an alias of an earlier row.  Every open row points to its anchor, and
    while some anchors are open, each pointer is exchanged for the pointer found there, which
    doubles its reach: a chain of n links takes log2(n) rounds.  On the way a row notes whether an
    e-mail stands between it and the end, since that turns a person's token into the token of its
    addresses.  Every round starts from a written table, so plans stay as small as the data.
    """
    rows = stage(rows)
    columns, pending = rows.columns, F.col("token").isNull()
    way = stage(
        rows.filter(pending).select("value", "anchor", F.col("anchor").alias("to"), (F.col("kind") == E.EMAIL_OF).alias("mail"))
    )
    n_open = way.count()
    if not n_open:
        return rows
    reach = 1
    while True:
        further = way.select(F.col("value").alias("to"), F.col("to").alias("_to"), F.col("mail").alias("_mail"))
        moved = stage(
            way.join(further, "to", "left").select(
                "value", "anchor", F.coalesce("_to", "to").alias("to"),
                (F.col("mail") | F.coalesce("_mail", F.lit(False))).alias("mail"), F.col("_to").isNotNull().alias("moved"),
            )
        )
        way = moved.drop("moved")
        still = moved.agg(F.count_if("moved")).first()[0]
        if not still:
            break
        # A pointer that still moves after more steps than there are open rows goes round.
        reach *= 2
        if reach > 2 * n_open:
            raise AliasDepthError(f"{still} aliases follow each other in a circle")
    lookup = rows.filter(~pending).select(F.col("value").alias("to"), F.col("token").alias("via"))
    if known is not None:
        lookup = lookup.unionByName(known.select(F.col("value").alias("to"), F.col("token").alias("via")))
    found = stage(way.join(lookup, "to", "left").select("value", "via", "mail"))
    lost = found.filter(F.col("via").isNull()).count()
    if lost:
        raise AliasDepthError(f"{lost} aliases have no anchor")
    resolved = rows.filter(pending).drop("token").join(
        found.select("value", _follow(F.col("via"), F.col("mail")).alias("token")), "value"
    )
    return rows.filter(~pending).unionByName(resolved.select(*columns))


def overwrite_usernames(rows: DataFrame, usernames: DataFrame, known: DataFrame | None) -> DataFrame:
    """Roster user names replace whatever token their value had; numbers stay consumed."""
    lookup = rows.select(F.col("value").alias("full_name"), "token")
    if known is not None:
        lookup = lookup.unionByName(known.select(F.col("value").alias("full_name"), "token"))
    last = (
        usernames.groupBy("username")
        .agg(F.max_by("full_name", "pos").alias("full_name"))
        .join(lookup, "full_name")
        .select(F.col("username").alias("value"), F.col("token").alias("new_token"))
    )
    marked = rows.join(last, "value", "left").withColumn(
        "displaced", F.col("new_token").isNotNull() & (F.col("new_token") != F.col("token"))
    )
    kept = marked.withColumn("active", ~F.col("displaced"))
    added = marked.filter("displaced").withColumns(
        {
            "etype": F.lit("PERSON"),
            "kind": F.lit(E.ALIAS),
            "token": F.col("new_token"),
            "active": F.lit(True),
        }
    )
    return kept.unionByName(added).drop("new_token", "displaced")


def build(
    events: DataFrame,
    masks: dict | None = None,
    *,
    bound: int | None = None,
    previous: Previous | DataFrame | None = None,
    usernames: DataFrame | None = None,
    linked: bool = False,
    single_task_rows: int = 1_000_000,
) -> DataFrame:
    """Registry rows of *events*; values already in *previous* keep their tokens there.

    The result holds only the new rows, so a continued registry is
    ``previous.unionByName(new)``.  *bound* is an upper limit of the number of distinct
    values (counted here if not given), and *linked* tells whether events may refer to an
    anchor.
    """
    masks = masks or {}
    if isinstance(previous, DataFrame):
        previous = whole(previous)
    known = None if previous is None else forward(previous.rows)
    rows = winners(events, known)
    if bound is None:
        rows = cut(rows)
        bound = rows.count()
    rows = number(rows, bound, single_task_rows)
    batch = 0
    if previous is not None:
        batch = 1 + previous.batch
        # One row per type.
        rows = rows.join(F.broadcast(previous.tops), "etype", "left").withColumn(
            "n", F.col("n") + F.coalesce(F.col("top"), F.lit(0))
        )
    rows = rows.withColumn("token", tokens(masks)).select(
        "value", "etype", "token", "kind", "n", "anchor", "seq"
    )
    if linked or usernames is not None:
        rows = link(rows, known)
    if usernames is None:
        rows = rows.withColumn("active", F.lit(True))
    else:
        rows = overwrite_usernames(rows, usernames, known)
    follows = S.person_number(F.col("token"))
    return rows.select(
        "value", "etype", "token", "kind",
        F.when(F.col("kind").isin(*NUMBERED), F.col("n")).otherwise(follows).alias("n"),
        F.col("token").startswith("[").alias("restorable"),
        "active", F.lit(batch).alias("batch"), "seq",
    )


def forward(registry: DataFrame) -> DataFrame:
    """``value -> token``."""
    return registry.filter("active").select("value", "token")


def reverse(registry: DataFrame) -> DataFrame:
    """``token -> value``: per token the value that had it first; masks never restore.

    The value that took a token's number always had it before any alias.
    """
    place = F.struct(F.col("batch"), (~F.col("kind").isin(*NUMBERED)).alias("follows"), F.col("seq"))
    return (
        registry.filter("restorable")
        .groupBy(F.upper("token").alias("token"))
        .agg(F.min_by("value", place).alias("value"))
    )
