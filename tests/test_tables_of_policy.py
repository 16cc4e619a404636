"""Policies and domain endings as tables against the same as lists; IPv6 against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

import veilmark as V
from veilmark.functions import patterns as P
from veilmark.functions import spans as SP
from veilmark.operators import detect as DET

TEXTS = [
    (1, "Ann Lee (ANN@x.example.com) met Bob Ray (bob@x.example.com) at 10.0.0.1"), (2, "bob@x.example.com again"),
    (3, None), (4, "nothing"), (5, "10.0.0.1 and mail.x.example.com"), (5, "10.0.0.1"),
]


@pytest.fixture(scope="module")
def base(spark):
    names = spark.createDataFrame([("Ann Lee", "PERSON"), ("Bob Ray", "PERSON")], "term string, etype string")
    return V.Settings(lexicon=names)


def texts(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(TEXTS)], "key int, id int, text string").repartition(2)


@pytest.mark.parametrize("terms", [["bob@x.example.com"], ["BOB@X.example.com", "10.0.0.1"], ["zz"], []])
def test_excluded_terms(spark, base, terms):
    table = spark.createDataFrame([(t,) for t in [*terms, None]], "term string")
    wanted = V.pseudonymise_text(texts(spark), "text", ["key"], base.with_(exclude_terms=terms))
    got = V.pseudonymise_text(texts(spark), "text", ["key"], base.with_(exclude_terms=table))
    assert sorted(map(str, got.df.collect())) == sorted(map(str, wanted.df.collect()))


@pytest.mark.parametrize("values", [["ann lee", "ann@x.example.com"], [" BOB RAY "], ["10.0.0.1"]])
def test_subjects(spark, base, values):
    table = spark.createDataFrame([(v,) for v in values], "value string")
    for bound in (0, 32 << 20):
        settings = base.with_(broadcast_bytes=bound)
        wanted = V.pseudonymise_text(texts(spark), "text", ["key"], settings.with_(subject_values=values))
        got = V.pseudonymise_text(texts(spark), "text", ["key"], settings.with_(subject_values=table))
        assert sorted(map(str, got.df.collect())) == sorted(map(str, wanted.df.collect()))


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_subjects_in_tables(spark, base, bound):
    rows = [(1, "Ann Lee", "ann@x.example.com", "Ann Lee here"), (2, "Bob Ray", "bob@x.example.com", "asks Ann Lee"), (3, "Ann Lee", None, "Bob Ray")]
    df = spark.createDataFrame(rows, "id int, name string, email string, note string")
    settings = base.with_(correlated_fields=("email",), broadcast_bytes=bound)
    values = ["ann lee", "ann@x.example.com"]
    table = spark.createDataFrame([(v,) for v in values], "value string")
    wanted = V.pseudonymise_table(df, ["id"], settings.with_(subject_values=values))
    got = V.pseudonymise_table(df, ["id"], settings.with_(subject_values=table))
    assert sorted(map(str, got.df.collect())) == sorted(map(str, wanted.df.collect()))


def test_domain_endings(spark):
    suffixes = spark.createDataFrame([(".PL",), ("co.example",), ("xyz",), (None,), ("",)], "suffix string")
    df = spark.createDataFrame([(1, "foo.pl a.b.co.example x.example foo.com q.XYZ xyz"), (2, "none")], "id int, text string")
    found = DET.detect(df, "text", ["id"], V.Settings(domain_suffixes=suffixes)).collect()
    assert {s["value"] for r in found for s in r["entities"]} == {"foo.pl", "a.b.co.example", "q.XYZ"}
    none = spark.createDataFrame([], "suffix string")
    assert DET.detect(df, "text", ["id"], V.Settings(domain_suffixes=none)).count() == 0


def test_ipv6_is_that_of_the_standard_library(spark):
    rng = random.Random(3)

    def candidate():
        groups = [format(rng.randrange(1 << rng.choice([4, 16, 20])), "x") for _ in range(rng.randint(1, 9))]
        text = ":".join(groups)
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["::", ":", ""]) + text[at:]
        return text + rng.choice(["", "", ":1.2.3.4", ":1.2.3.400", "::"])

    def valid(text):
        try:
            # An IPv4 tail with leading zeros is no address to the library.
            ipaddress.IPv6Address(text)
            return any(c.isdigit() for c in text)
        except ValueError:
            return False

    values = sorted({candidate() for _ in range(4000)} | {"::", "::1", "1::", "a::b", "1:2:3:4:5:6:7:8", "::1.2.3.4", "1.2.3.4"})
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("ok", F.expr(SP.is_ipv6("v")))
    wrong = [(r.v, r.ok) for r in df.collect() if r.ok != valid(r.v)]
    assert not wrong
    assert sum(map(valid, values)) > 100


def test_ipv6_in_sentences(spark):
    text = "to 2001:db8::8a2e:370:7334, fe80::1. Or ::1: no 12:30:45, std::deadbeef, x::y and 00:1A:2B:3C:4D:5E"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.expr(SP.rule_spans("t", P.IPV6_RULE)).alias("s")).first()["s"]
    assert [s["value"] for s in got] == ["2001:db8::8a2e:370:7334", "fe80::1", "::1"]
    assert all(text[s["start"] : s["end"]] == s["value"] for s in got)
