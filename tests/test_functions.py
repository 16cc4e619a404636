import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions import rewrite as R
from veilmark.functions import scalars as S
from veilmark.functions import spans as SP


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "card, rule, masked",
    [
        ("4111 1111 1111 1111", None, "411111XXXXXX1111"),
        ("4111-1111-1111-1111", {"keep_first": 4, "keep_last": 4, "fill_char": "*"}, "4111********1111"),
        ("4111111111", None, "XXXXXXXXXX"),
        ("4111111111111111", {"keep_last": 0}, "411111XXXXXXXXXX"),
    ],
)
def test_card_mask(spark, card, rule, masked):
    assert one(spark, card, S.card_mask(F.col("v"), rule)) == masked


def test_names(spark):
    df = spark.createDataFrame([("Mary Jane Watson",), (" cher ",), ("ann lee",)], "v string")
    v = F.col("v")
    rows = df.select(S.initials(v), S.first_word(v), S.last_word(v), S.is_multi_word(v)).collect()
    assert [tuple(r) for r in rows] == [
        ("M.J.W.", "Mary", "Watson", True), ("C.", "cher", "cher", False), ("A.L.", "ann", "lee", True),
    ]


def test_cell_text(spark):
    values = ["  x y ", "", "  ", "NaN", " none", "<NA>", None, "nano"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(S.cell_text(F.col("v")), F.expr(S.cell_text_sql("v"))).collect()
    assert [r[0] for r in rows] == ["x y", None, None, None, None, None, None, "nano"]
    assert all(r[0] == r[1] for r in rows)


def test_person_number(spark):
    values = ["[PERSON_5]", "[PERSON_12_FIRST]", "7_J.D.", "[EMAIL_3]", "[EMAIL_PERSON_3]", "x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(S.person_number(F.col("v"))).collect()] == [5, 12, 7, None, None, None]


def test_output_names(spark):
    values = ["/d.x/report.txt", "a.b.csv", "/d/plain", "mail.eml"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    rows = df.select(S.redacted_name(v), S.restored_name(v), S.redacted_name(v, ".txt")).collect()
    assert [r[0] for r in rows] == ["/d.x/report.redacted.txt", "a.b.redacted.csv", "/d/plain.redacted", "mail.redacted.eml"]
    assert rows[0][1] == "/d.x/report.restored.txt" and rows[3][2] == "mail.redacted.txt"


@pytest.mark.parametrize(
    "etype, text, found",
    [
        ("EMAIL", "write to john.doe@acme.com.", ["john.doe@acme.com"]),
        ("PHONE", "+1 (555) 867-5309 or +44 20 7946 0958, 555-234-5678", ["+1 (555) 867-5309", "+44 20 7946 0958", "555-234-5678"]),
        ("IP", "at 192.168.1.10. not 300.1.1.1 nor 1.2.3.4.5", ["192.168.1.10"]),
        ("DOMAIN", "see ftp.acme.com, not e.g. this.one", ["ftp.acme.com"]),
        ("URL", "(https://a.example.org/x?y=1#z).", ["https://a.example.org/x?y=1#z"]),
        ("CREDIT_CARD", "4111 1111 1111 1111, 4111111111111112, 378282246310005", ["4111 1111 1111 1111", "378282246310005"]),
        ("IBAN_CODE", "GB29NWBK60161331926819 and GB30NWBK60161331926819, DE89 3704 0044 0532 0130 00", ["GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00"]),
        ("MAC_ADDRESS", "00:1A:2B:3C:4D:5E", ["00:1A:2B:3C:4D:5E"]),
        ("AMOUNT", "cost $52,340 or 12.50 EUR or € 3", ["$52,340", "12.50 EUR"]),
        ("EMAIL", "x " + "ab" * 40 + "@mail.example.com end", ["ab" * 40 + "@mail.example.com"]),
        ("EMAIL", "j@a1.b2.c3.d4.e5.f6.g7.h8.i9.example.com", ["j@a1.b2.c3.d4.e5.f6.g7.h8.i9.example.com"]),
        ("EMAIL", "a@b.com-x@y.com", ["a@b.com", "-x@y.com"]),
        ("AMOUNT", "5$20 and $12345678901234567890 or 1234567890123456789 EUR", ["$20", "$12345678901234567890", "1234567890123456789 EUR"]),
        ("DOMAIN", "at a.b.c.d.e.f.g.h.i.j.example.com", ["a.b.c.d.e.f.g.h.i.j.example.com"]),
    ],
)
def test_rules(spark, etype, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    spans = df.select(F.expr(SP.rule_spans("t", P.PATTERN_RULES[etype])).alias("s")).first()["s"]
    assert [s["value"] for s in spans] == found
    assert all(text[s["start"]:s["end"]] == s["value"] for s in spans)


@pytest.mark.parametrize("etype", [r.etype for r in P.PATTERN_RULES.values() if r.fast])
def test_fast_forms_find_the_same(spark, etype):
    rule, rng = P.PATTERN_RULES[etype], random.Random(5)
    texts = [("".join(rng.choices(["a", "com", "co", ".", "@", "-", "1", "25", ",50", "$", " EUR", " "], k=40)),) for _ in range(800)]
    df = spark.createDataFrame(texts, "t string")
    found = [f"regexp_extract_all(t, {SP.lit(form)}, 0)" for form in (rule.fast, rule.pattern)]
    assert df.filter(F.expr(f"{found[0]} <> {found[1]}")).count() == 0
    assert df.filter(F.expr(f"size({found[1]}) > 0")).count() > 10


def test_long_runs_are_quick(spark):
    df = spark.createDataFrame([("a1" * 200_000 + " b@c.example.com",)], "t string")
    assert df.select(F.expr(SP.rule_spans("t", P.PATTERN_RULES["EMAIL"])).alias("s")).first()["s"][0]["value"] == "b@c.example.com"


def test_offsets_beyond_one_block(spark):
    text = " ".join(f"é{i} u{i}@mail.example.com" for i in range(700))
    df = spark.createDataFrame([(text,)], "t string")
    spans = df.select(F.expr(SP.rule_spans("t", P.PATTERN_RULES["EMAIL"])).alias("s")).first()["s"]
    assert len(spans) == 700
    assert all(text[s["start"]:s["end"]] == s["value"] for s in spans)


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[4], s[2] - s[3], s[2], s[0])):
        if all(s[3] <= k[2] or k[3] <= s[2] for k in kept):
            kept.append(s)
    return kept


def test_overlaps_against_greedy(spark):
    rnd = random.Random(7)
    cases = []
    for i in range(60):
        spans = []
        for _ in range(rnd.randrange(0, 25)):
            start, length = rnd.randrange(0, 60), rnd.randrange(1, 12)
            spans.append((rnd.choice("ABC"), f"v{start}", start, start + length, rnd.choice([0.4, 0.6, 0.99])))
        cases.append((i, spans))
    df = spark.createDataFrame(
        cases, "i int, s array<struct<etype:string,value:string,start:int,end:int,score:double>>"
    )
    out = df.select("i", F.expr(SP.drop_overlaps(f"CAST(s AS {SP.SPANS_TYPE})")).alias("s")).collect()
    for row in out:
        got = [(s["etype"], s["start"], s["end"]) for s in row["s"]]
        assert got == [(s[0], s[2], s[3]) for s in greedy(dict(cases)[row["i"]])]


def rewritten(spark, text, mapping, **options):
    df = spark.createDataFrame([(text, mapping)], "t string, m map<string,string>")
    df = df.withColumn("p", F.expr(R.key_pattern("m", **options)))
    return df.select(F.expr(R.replace_values("t", "m", "p")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, mapping, expected",
    [
        ("John Doe and John attended.", {"John Doe": "[PERSON_1]", "John": "[PERSON_1_FIRST]"}, "[PERSON_1] and [PERSON_1_FIRST] attended."),
        ("Acme and Acme Corporation met.", {"Acme Corporation": "[COMPANY_1]"}, "Acme and [COMPANY_1] met."),
        ("a.c abc", {"a.c": "X"}, "X abc"),
        (r"x\Ey$1^ {2}", {r"\Ey$1": r"\2$3", "^ {2}": "[Z]"}, r"x\2$3[Z]"),
        ("May met the Mayor", {"May": "[P]"}, "[P] met the [P]or"),
        ("unchanged", {}, "unchanged"),
        ("zz", {"z": "zz"}, "zzzz"),
    ],
)
def test_replace(spark, text, mapping, expected):
    assert rewritten(spark, text, mapping) == expected


def test_replace_whole_words(spark):
    assert rewritten(spark, "May met the Mayor", {"May": "[P]"}, word_boundary=True) == "[P] met the Mayor"


def test_replace_against_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(5):
        keys = {"".join(rnd.choice("ab.") for _ in range(rnd.randrange(1, 4))): f"<{i}>" for i in range(6)}
        text = "".join(rnd.choice("ab. ") for _ in range(80))
        pattern = "|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True))
        assert rewritten(spark, text, keys) == re.sub(pattern, lambda m: keys[m.group()], text)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[person_1] `[PERSON_1]` **[Person_1]** [PERSON_99] [a b]", "Jo `Jo` **Jo** [PERSON_99] [a b]"),
        ("[[PERSON_1]]", "[Jo]"),
        ("[PERSON_1 ]", "[PERSON_1 ]"),
    ],
)
def test_restore_tokens(spark, text, expected):
    df = spark.createDataFrame([(text, {"[PERSON_1]": "Jo"})], "t string, m map<string,string>")
    assert df.select(F.expr(R.restore_tokens("t", "m"))).first()[0] == expected


def test_result_can_feed_a_python_udf(spark):
    """Guards against lambdas that Spark cannot hand to a Python worker."""

    @F.pandas_udf("int")
    def size(texts):
        return texts.str.len()

    df = spark.createDataFrame([("a b", {"a": "[X_1]"})], "t string, m map<string,string>")
    df = df.withColumn("p", F.expr(R.key_pattern("m")))
    out = df.withColumn("r", F.expr(R.replace_values("t", "m", "p")))
    assert out.select(size("r")).first()[0] == len("[X_1] b")


def test_large_maps_are_rewritten_like_small_ones(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from veilmark.operators import rewrite as REW

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab_1é \U0001F600") for _ in range(n))
    values = {word(rng.randint(1, 5)) for _ in range(300)}
    mapping = {v: f"[T_{i}]" for i, v in enumerate(sorted(values))}
    assert len(mapping) > REW.LARGE_MAP
    texts = [word(400), "", "plain", None]
    maps = spark.createDataFrame([(i, mapping) for i in range(4)] + [(4, {"a": "[X]"})], "id int, mapping map<string,string>")
    df = spark.createDataFrame([*enumerate(texts), (4, "ab a"), (5, "ab a")], "id int, text string")
    either = "|".join(re.escape(k) for k in sorted(mapping, key=lambda k: (-len(k), k)))
    for bounded in (False, True):
        pattern = rf"(?<![^\W])(?:{either})(?![^\W])" if bounded else either
        want = [None if t is None else re.sub(pattern, lambda m: mapping[m[0]], t) for t in texts]
        out = REW.rewrite_text(df, ["id"], "text", maps, 0, 1 << 20, word_boundary=bounded, large=True)
        got = dict(out.select("id", "text").collect())
        assert [got[i] for i in range(4)] == want
        assert got[4] == ("ab [X]" if bounded else "[X]b [X]") and got[5] == "ab a"


def test_look_up_does_not_try_every_value():
    import time

    from veilmark.operators import rewrite as REW

    mapping = {f"c{i}@x.example.com": f"[{i}]" for i in range(40000)}
    text = "\n".join(f"write to {k} soon" for k in mapping)
    began = time.perf_counter()
    out = REW.exchanger(mapping, False)(text)
    assert out == "\n".join(f"write to {t} soon" for t in mapping.values())
    assert time.perf_counter() - began < 30
