import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark import Settings, pseudonymise_table
from veilmark.operators import events as E
from veilmark.operators import registry as REG
from veilmark.operators import roster as ROS
import veilmark as V
from veilmark.sources import registry_store as STORE

MASKS = {"PERSON": {}, "CREDIT_CARD": {}}


def events(spark, rows, start=0):
    """(value, etype, kind) rows in order."""
    data = [(start + i, v, t, k) for i, (v, t, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, value string, etype string, kind string").repartition(3)
    order = F.struct(F.col("i").alias("o0"))
    return df.select(
        "value", "etype", "kind", F.lit(None).cast("string").alias("anchor"),
        E.seq(F.lit(0), order, F.lit(0), F.lit(0)).alias("seq"),
    )


def people(spark, *names, start=0):
    return events(spark, [(n, "PERSON", E.PERSON) for n in names], start)


def forward(registry):
    return {r["value"]: r["token"] for r in REG.forward(registry).collect()}


@pytest.mark.parametrize(
    "names, expected",
    [
        (["John Doe"], {"John Doe": "[PERSON_1]", "John": "[PERSON_1_FIRST]", "Doe": "[PERSON_1_LAST]"}),
        (["Alice"], {"Alice": "[PERSON_1]"}),
        (["John Doe", "John", "John Doe"], {"John Doe": "[PERSON_1]", "John": "[PERSON_1_FIRST]", "Doe": "[PERSON_1_LAST]"}),
        (
            ["John Doe", "John Smith"],
            {
                "John Doe": "[PERSON_1]", "John": "[PERSON_1_FIRST]", "Doe": "[PERSON_1_LAST]",
                "John Smith": "[PERSON_2]", "Smith": "[PERSON_2_LAST]",
            },
        ),
        (["John", "John Doe"], {"John": "[PERSON_1]", "John Doe": "[PERSON_2]", "Doe": "[PERSON_2_LAST]"}),
        (["Bo Bo"], {"Bo Bo": "[PERSON_1]", "Bo": "[PERSON_1_FIRST]"}),
    ],
)
def test_person_model(spark, names, expected):
    assert forward(REG.build(people(spark, *names))) == expected


def test_person_masks(spark):
    registry = REG.build(people(spark, "John Doe", "Jane Doe", "Mary Jane Watson"), MASKS)
    got = forward(registry)
    assert got["John Doe"] == "1_J.D." and got["Jane Doe"] == "2_J.D." and got["Mary Jane Watson"] == "3_M.J.W."
    assert got["John"] == "1_J." and got["Doe"] == "1_D." and got["Jane"] == "2_J." and got["Watson"] == "3_W."
    assert REG.reverse(registry).count() == 0


def test_types_count_separately_and_first_type_wins(spark):
    rows = [("a@b.c", "EMAIL", E.TOKEN), ("Acme", "COMPANY", E.TOKEN), ("ACME", "COMPANY", E.TOKEN),
            ("Acme", "ORG", E.TOKEN), ("b@b.c", "EMAIL", E.TOKEN)]
    assert forward(REG.build(events(spark, rows))) == {
        "a@b.c": "[EMAIL_1]", "b@b.c": "[EMAIL_2]", "Acme": "[COMPANY_1]", "ACME": "[COMPANY_2]",
    }


def test_masked_cards_take_no_number(spark):
    rows = [("4111 1111 1111 1111", "CREDIT_CARD", E.CARD), ("Al Bo", "PERSON", E.PERSON)]
    registry = REG.build(events(spark, rows), {"CREDIT_CARD": {"keep_first": 4, "fill_char": "*"}})
    assert forward(registry)["4111 1111 1111 1111"] == "4111********1111"
    assert [r["value"] for r in REG.reverse(registry).filter("token = '[PERSON_1]'").collect()] == ["Al Bo"]


def test_continuation(spark, tmp_path):
    first = REG.build(people(spark, "John Doe", "Jane Roe"))
    path = str(tmp_path / "registry")
    assert not STORE.exists(spark, path)
    with pytest.raises(STORE.RegistryError):
        STORE.load(spark, path)
    STORE.save(first, path)
    loaded = STORE.load(spark, path)
    second = REG.build(people(spark, "Jane Roe", "Jane Poe", "Doe", "New"), previous=loaded)
    assert forward(second) == {"Jane Poe": "[PERSON_3]", "Poe": "[PERSON_3_LAST]", "New": "[PERSON_4]"}
    both = loaded.unionByName(second)
    third = REG.build(people(spark, "Last One"), previous=both)
    assert forward(third)["Last One"] == "[PERSON_5]"
    STORE.save(both, path)
    STORE.save(STORE.load(spark, path).unionByName(third), path)
    assert STORE.load(spark, path).count() == both.count() + third.count()
    STORE.clear(spark, path)
    assert STORE.load(spark, path).count() == 0


def test_roster_without_positions(spark):
    names = spark.createDataFrame([("Cy Fox",), ("Ann Lee",), ("Bob Ray",)], "full_name string")
    docs = spark.createDataFrame([(1, "Lee met Bob Ray")], "id int, text string")
    result = V.pseudonymise_text(docs, "text", ["id"], V.Settings(roster=names))
    tokens = {r["value"]: r["token"] for r in result.registry.collect()}
    assert [tokens[v] for v in ("Ann Lee", "Lee", "Bob", "Fox")] == ["[PERSON_1]", "[PERSON_1_LAST]", "[PERSON_2_FIRST]", "[PERSON_3_LAST]"]


def test_range_numbering_equals_window(spark):
    rnd = random.Random(1)
    names = [" ".join(rnd.sample("ann bea cy dan eva fay".split(), rnd.choice([1, 2, 2]))) for _ in range(300)]
    one = forward(REG.build(people(spark, *names)))
    assert one == forward(REG.build(people(spark, *names), single_task_rows=7))


def blank(v):
    return v is None or v.strip().lower() in ("", "nan")


def registered(rows):
    """Registrations in order: ``(value, kind, anchor)``, as a table of facts about the cells."""
    out = []
    for _, anchor, c1, c2, forced in rows:
        alone = blank(anchor)
        if not alone:
            out.append((anchor, "name", None))
        for cell in (c1, c2):
            if not blank(cell):
                out.append((cell, ("mail" if "@" in cell else "word") if alone else "follows", None if alone else anchor))
        if not blank(forced):
            out.append((forced, "mail" if "@" in forced else "name", None))
    return out


def check_registry(tokens, rows, masked):
    """Every statement about the finished registry follows from which registration of a value came first."""
    facts = registered(rows)
    first = {}
    for place, (value, kind, anchor) in enumerate(facts):
        if value not in first:
            first[value] = (place, kind, anchor)
        # A new name brings its first and last word, right behind it.
        if kind == "name" and first[value][0] == place and len(value.split()) > 1:
            for sub, word in ((0.1, value.split()[0]), (0.2, value.split()[-1])):
                first.setdefault(word, (place + sub, "first" if sub == 0.1 else "last", value))
    assert set(tokens) == set(first)
    numbered = [v for v, _ in sorted(first.items(), key=lambda f: f[1][0]) if first[v][1] in ("name", "word")]
    number = {v: k for k, v in enumerate(numbered, 1)}
    mails = [v for v, _ in sorted(first.items(), key=lambda f: f[1][0]) if first[v][1] == "mail"]
    for value, token in tokens.items():
        _, kind, anchor = first[value]
        if kind == "mail":
            assert token == f"[EMAIL_{mails.index(value) + 1}]"
        elif kind == "word" or kind == "name" and not masked:
            assert token == f"[PERSON_{number[value]}]"
        elif kind == "name":
            assert token == f"{number[value]}_" + "".join(f"{w[0].upper()}." for w in value.split())
        elif kind in ("first", "last"):
            assert token == (f"{number[anchor]}_{value[0].upper()}." if masked else f"[PERSON_{number[anchor]}_{kind.upper()}]")
        else:
            person = re.match(r"\[PERSON_(\d+)|(\d+)_", tokens[anchor])
            n = person and (person[1] or person[2])
            assert token == (f"[EMAIL_PERSON_{n}]" if "@" in value and n else tokens[anchor])


@pytest.mark.parametrize("masked", [False, True])
@pytest.mark.parametrize("seed", range(2))
def test_tables_of_random_cells(spark, seed, masked):
    """Anchors, aliases of aliases, correlated and forced cells from one small pool."""
    rnd = random.Random(seed)
    pool = ["ann", "bo", "cy", "ann bo", "bo cy", "cy ann", "E1", "E2", "a@x.de", "b@x.de", "c@x.de"]
    pick = lambda p: rnd.choice(pool) if rnd.random() > p else rnd.choice(["", " nan ", None])
    rows = [(i, pick(0.25), pick(0.2), pick(0.2), pick(0.4)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, user_id string, c1 string, c2 string, f string").repartition(3)
    settings = Settings(
        correlated_fields=("c1", "c2"), force_fields=("f",), mask=masked, masking_rules={"PERSON": {}}
    )
    result = pseudonymise_table(df, ["i"], settings, scan=[])
    tokens = forward(result.registry)
    check_registry(tokens, rows, masked)
    # A cell shows the token of its value; empty ones stay as they are.
    expected = {i: tuple(v if blank(v) else tokens[v] for v in row) for i, *row in rows}
    assert {r["i"]: tuple(r)[1:] for r in result.df.collect()} == expected
    back = {r["token"]: r["value"] for r in REG.reverse(result.registry).collect()}
    assert set(back) == {t.upper() for t in tokens.values() if t.startswith("[")}
    assert all(tokens[v].upper() == t for t, v in back.items())
    shuffled = pseudonymise_table(df, ["i"], settings.with_(broadcast_bytes=0, single_task_rows=5), scan=[])
    assert {r["i"]: tuple(r)[1:] for r in shuffled.df.collect()} == expected


def test_roster_merge(spark):
    schema = "pos bigint, full_name string, email string, username string"
    base = spark.createDataFrame([(0, "A B", "a@x", "ab"), (1, "C D", None, "cd"), (2, "A B", None, "ab2")], schema)
    extra = spark.createDataFrame([(0, "C D", "c@x", None), (1, "E F", None, None)], schema)
    rows = ROS.merge(base, extra).orderBy("source", "pos").collect()
    assert [(r["full_name"], r["email"], r["username"]) for r in rows] == [
        ("A B", None, "ab2"), ("C D", "c@x", None), ("E F", None, None),
    ]


def test_username_conflicts(spark):
    rows = [(0, "Ann Bo", None, "ab"), (1, "Cy Di", None, "Ann"), (2, "Ed Fo", None, "ab"), (3, "Gi Ho", None, "gh")]
    roster = spark.createDataFrame(rows, "pos bigint, full_name string, email string, username string")
    assert {r["username"] for r in ROS.username_conflicts(roster).collect()} == {"ab", "Ann"}


def test_username_overwrites(spark):
    """A user name that equals an earlier full name takes its token away; both restore."""
    rows = [(0, "Ann Bo", None, None), (1, "Cy Di", None, "Ann Bo")]
    roster = spark.createDataFrame(rows, "pos bigint, full_name string, email string, username string")
    df = spark.createDataFrame([(1, "x")], "i int, user_id string")
    registry = pseudonymise_table(df, ["i"], Settings(roster=roster), scan=[]).registry
    got = forward(registry)
    assert got["Ann Bo"] == "[PERSON_2]" and got["x"] == "[PERSON_3]"
    back = {r["token"]: r["value"] for r in REG.reverse(registry).collect()}
    assert back["[PERSON_1]"] == "Ann Bo" and back["[PERSON_2]"] == "Cy Di"


def chain_rows(n):
    """Each row's anchor is the alias the row before has registered."""
    return [(i, f"v{i}", f"v{i + 1}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 24, 100, 5000])
def test_alias_chains_of_any_length(spark, n):
    df = spark.createDataFrame(chain_rows(n), "i int, user string, login string").repartition(4)
    out = pseudonymise_table(df, ["i"], Settings(correlated_fields=("login",)), scan=[])
    assert {(r.user, r.login) for r in out.df.collect()} == {("[PERSON_1]", "[PERSON_1]")}
    assert out.registry.count() == n + 1


def test_mail_inside_a_chain(spark):
    rows = [(0, "Ann Lee", "ann"), (1, "ann", "a@x.example.com"), (2, "a@x.example.com", "desk"), (3, "desk", "d@x.example.com")]
    df = spark.createDataFrame(rows, "i int, user string, login string")
    out = pseudonymise_table(df, ["i"], Settings(correlated_fields=("login",)), scan=[]).df.orderBy("i").collect()
    assert [(r.user, r.login) for r in out] == [
        ("[PERSON_1]", "[PERSON_1]"), ("[PERSON_1]", "[EMAIL_PERSON_1]"),
        ("[EMAIL_PERSON_1]", "[EMAIL_PERSON_1]"), ("[EMAIL_PERSON_1]", "[EMAIL_PERSON_1]"),
    ]


def linked(spark, rows):
    """Registry rows ``(value, kind, anchor, token)`` as :func:`REG.link` takes them."""
    df = spark.createDataFrame(rows, "value string, kind string, anchor string, token string")
    return df.selectExpr("value", "'PERSON' AS etype", "token", "kind", "0L AS n", "anchor", "struct(value) AS seq")


def test_link_reports_circles_and_lost_anchors(spark):
    ring = [("a", E.ALIAS, "b", None), ("b", E.ALIAS, "c", None), ("c", E.ALIAS, "a", None), ("r", E.PERSON, None, "[PERSON_1]")]
    with pytest.raises(REG.AliasDepthError, match="circle"):
        REG.link(linked(spark, ring))
    with pytest.raises(REG.AliasDepthError, match="no anchor"):
        REG.link(linked(spark, [("a", E.ALIAS, "gone", None)]))
    known = spark.createDataFrame([("old", "[PERSON_7]")], "value string, token string")
    rows = [("x@y.example.com", E.EMAIL_OF, "mid", None), ("mid", E.ALIAS, "old", None)]
    got = {r.value: r.token for r in REG.link(linked(spark, rows), known).collect()}
    assert got == {"x@y.example.com": "[EMAIL_PERSON_7]", "mid": "[PERSON_7]"}


def test_events_are_read_once(spark):
    """Name parts come from the settled values; the events behind them are not evaluated again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    rows = spark.range(200).select(F.concat(F.lit("Ann Lee"), (F.col("id") % 20).cast("string")).alias("value"), "id")
    place = E.seq(F.lit(0), F.struct(F.col("id").alias("o0")), F.lit(0), F.lit(0))
    events = rows.select(
        counted("value").alias("value"), F.lit("PERSON").alias("etype"), F.lit(E.PERSON).alias("kind"),
        F.lit(None).cast("string").alias("anchor"), place.alias("seq"),
    )
    assert REG.build(events).count() == 20 + 1 + 20
    assert seen.value == 200
