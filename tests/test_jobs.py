import pytest
from pyspark.sql import functions as F

import veilmark as V
from veilmark.config import SettingsError, for_redact, passthrough_for_redact, passthrough_for_tokens
from veilmark.operators import audit as AUD
from veilmark.operators import common as COMMON
from veilmark.operators import registry as REG
from veilmark.operators import structured as STR
from veilmark.operators.subject import SubjectError, subject_table, subject_values

TERMS = ("Nordwind Trading", "nordwind.com", "Project Heron")


def text_of(df):
    return df.first()["text"]


def test_memo(spark, memo, roster):
    result = V.pseudonymise_text(memo, "text", ["id"], V.Settings(company_terms=TERMS, roster=roster))
    text = text_of(result.df)
    for value in ("Jonas Weber", "m.lund@", "192.168.10.42", "867-5309", "Nordwind Trading", "NORDWIND", "jweber"):
        assert value not in text
    assert text.count("[PERSON_1]") == 3 and "Log of [PERSON_1]:" in text
    # The address must beat the company term inside it.
    assert "From: [PERSON_1] ([EMAIL_1])" in text and "To: [PERSON_2] ([EMAIL_2])" in text
    # Other spellings of a term are values of their own.
    tokens = {r["value"]: r["token"] for r in REG.forward(result.registry).collect()}
    assert tokens["Nordwind Trading"] != tokens["NORDWIND TRADING"]
    # A name part that is only in the registry is not replaced: it was not detected here.
    assert "Call Jonas at [PHONE_1]" in text and tokens["Jonas"] == "[PERSON_1_FIRST]"
    assert V.restore(result.df, ["text"], result.registry, ["id"]).first()["text"] == memo.first()["text"].replace("jweber", "Jonas Weber")
    assert V.audit(result.df, "text", ["id"], result.registry, hits=result.only_hits).count() == 0
    visible = {r["value"] for r in V.audit(result.df, "text", ["id"], result.registry).collect()}
    assert visible == {"Jonas"}


@pytest.mark.parametrize("changes", [{"small_dictionary_terms": 0}, {"small_dictionary_terms": 0, "dictionary_chars": 20}])
def test_dictionary_ways_agree(spark, memo, roster, changes):
    base = V.Settings(company_terms=TERMS, roster=roster)
    wanted = V.pseudonymise_text(memo, "text", ["id"], base)
    got = V.pseudonymise_text(memo, "text", ["id"], base.with_(**changes))
    assert text_of(got.df) == text_of(wanted.df)


@pytest.mark.parametrize("limit", [0, 64])
def test_letters_fold_alike_in_all_dictionary_ways(spark, limit):
    docs = spark.createDataFrame([(1, "a ma\u017fter, MASTER and m\u0130x")], "id int, text string")
    settings = V.Settings(company_terms=["master", "mix"], small_dictionary_terms=limit)
    text = V.pseudonymise_text(docs, "text", ["id"], settings).df.first()["text"]
    assert text == "a [COMPANY_1], [COMPANY_2] and [COMPANY_3]"


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_rows_that_repeat_a_key_keep_their_own_tokens(spark, bound):
    rows = spark.createDataFrame([(1, "x1"), (1, "x2"), (2, "x2")], "id int, user_id string")
    run = V.pseudonymise_table(rows, key=["id"], settings=V.Settings(broadcast_bytes=bound), anchor="user_id")
    tokens = {r["value"]: r["token"] for r in run.registry.collect()}
    assert sorted(map(tuple, run.df.collect())) == sorted([(1, tokens["x1"]), (1, tokens["x2"]), (2, tokens["x2"])])


def test_large_maps_leave_texts_without_hits_alone(spark):
    rows = [(i, f"mail u{i % 7}@a.example.com" if i % 3 else "nothing") for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    wanted = V.pseudonymise_text(df, "text", ["id"]).df
    got = V.pseudonymise_text(df, "text", ["id"], V.Settings(broadcast_bytes=0, single_task_rows=2)).df
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert got.filter("text = 'nothing'").count() == 20


def test_same_value_same_token_and_detector_order(spark):
    rows = [(1, "10.0.0.1 then a@b.example.com"), (2, "a@b.example.com from 10.0.0.2 and 10.0.0.1")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["text"] for r in V.pseudonymise_text(df, "text", ["id"]).df.collect()}
    assert got == {1: "[IP_1] then [EMAIL_1]", 2: "[EMAIL_1] from [IP_2] and [IP_1]"}
    # Of equal score the longer span is numbered first, whatever comes first in the text.
    two = spark.createDataFrame([(1, "10.0.0.1 and 192.168.10.10")], "id int, text string")
    assert text_of(V.pseudonymise_text(two, "text", ["id"]).df) == "[IP_2] and [IP_1]"


def test_paragraphs_share_their_document(spark):
    rows = [(1, 0, "call 555-234-5678"), (1, 1, "x5555-234-56789"), (2, 0, "nothing 555-234-567")]
    df = spark.createDataFrame(rows, "doc int, para int, text string")
    result = V.pseudonymise_text(df, "text", ["doc", "para"], document=["doc"])
    got = {(r["doc"], r["para"]): r["text"] for r in result.df.collect()}
    assert got[(1, 0)] == "call [PHONE_1]" and got[(1, 1)] == "x5[PHONE_1]9" and got[(2, 0)] == "nothing 555-234-567"


def test_previous_registry_continues(spark):
    schema = "id int, text string"
    first = V.pseudonymise_text(spark.createDataFrame([(1, "a@b.example.com")], schema), "text", ["id"])
    second = V.pseudonymise_text(
        spark.createDataFrame([(1, "c@b.example.com a@b.example.com")], schema), "text", ["id"], previous=first.registry
    )
    assert text_of(second.df) == "[EMAIL_2] [EMAIL_1]"
    assert second.registry.count() == 2 and second.added.count() == 1


def test_redact_mode(spark):
    text = "Ann Lee paid $52,340 from GB29NWBK60161331926819 via 00:1A:2B:3C:4D:5E, card 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    names = spark.createDataFrame([("Ann Lee", "PERSON")], "term string, etype string")
    settings = V.Settings(lexicon=names, redact_profiles={"open": {"passthrough": ["person", "credit_card"]}})
    assert text_of(V.redact_text(df, "text", ["id"], settings)) == (
        "1_A.L. paid [AMOUNT_1] from [IBAN_CODE_1] via [MAC_ADDRESS_1], card 411111XXXXXX1111"
    )
    assert text_of(V.redact_text(df, "text", ["id"], settings, profile="open", passthrough=["amount"])) == (
        "Ann Lee paid $52,340 from [IBAN_CODE_1] via [MAC_ADDRESS_1], card 411111XXXXXX1111"
    )
    # Outside redaction the three extra types are not looked for.
    plain = text_of(V.pseudonymise_text(df, "text", ["id"], settings).df)
    assert plain == text.replace("Ann Lee", "[PERSON_1]").replace("4111 1111 1111 1111", "[CREDIT_CARD_1]")
    with pytest.raises(SettingsError, match="open"):
        V.redact_text(df, "text", ["id"], settings, profile="missing")


def test_policy_sets():
    assert passthrough_for_tokens(["IP", "EMAIL"], ["URL", "COMPANY"]) == {"IP", "URL"}
    base = V.Settings(passthrough_types=("URL",), redact_profiles={"p": {"passthrough": ["email", "Credit_Card"]}})
    assert passthrough_for_redact(base, "p", ["ip"]) == {"EMAIL", "IP"}
    assert set(for_redact(base, "p").dropped_types) == {"EMAIL"}
    assert base.active_masks == {} and for_redact(base).active_masks == {"PERSON": {}, "CREDIT_CARD": {}}


def test_subject(spark):
    assert subject_values({"full_name": " Ann Mae Lee ", "email": "a@b.c"}) == ["Ann", "Ann Mae Lee", "Lee", "a@b.c"]
    assert subject_values({"full_name": "Ann Lee", "first_name": "Anna"}) == ["Ann Lee", "Anna", "Lee"]
    with pytest.raises(SubjectError):
        subject_values({"full_name": "  ", "other": "x"})
    row = [(" Ann Mae Lee ", "a@b.c", ""), (None, None, "Anna")]
    df = spark.createDataFrame(row, "full_name string, email string, first_name string")
    assert sorted(r["value"] for r in subject_table(df).collect()) == ["Ann", "Ann Mae Lee", "Anna", "Lee", "a@b.c"]


def test_dsar(spark):
    names = spark.createDataFrame([("Ann Lee", "PERSON"), ("Bob Ray", "PERSON")], "term string, etype string")
    df = spark.createDataFrame([(1, "Ann Lee (ANN@x.example.com) met Bob Ray (bob@x.example.com)")], "id int, text string")
    subject = {"full_name": "ann lee", "email": "ann@x.example.com"}
    settings = V.Settings(lexicon=names, passthrough_types=("EMAIL", "IP"))
    assert text_of(V.dsar_text(df, "text", ["id"], subject, settings)) == (
        "Ann Lee (ANN@x.example.com) met 1_B.R. ([EMAIL_1])"
    )
    rows = [(1, "Ann Lee", "ann@x.example.com", "Ann Lee here"), (2, "Bob Ray", "bob@x.example.com", "asks Ann Lee")]
    table = spark.createDataFrame(rows, "id int, name string, email string, note string")
    out = V.dsar_table(table, ["id"], subject, settings.with_(correlated_fields=("email",)))
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, "Ann Lee", "ann@x.example.com", "Ann Lee here"), (2, "2_B.R.", "[EMAIL_PERSON_2]", "asks Ann Lee"),
    ]


def test_anchor_resolution():
    columns = ["Employee_ID", "full_name", "email", "USER"]
    assert STR.resolve_anchor(columns, "email", "full_name") == "email"
    assert STR.resolve_anchor(columns, "EMAIL", None) == "email"
    assert STR.resolve_anchor(columns, "missing", "Full_Name") == "full_name"
    assert STR.resolve_anchor(columns, None, None) == "Employee_ID"
    assert STR.resolve_anchor(["city"], None, None) is None


PEOPLE = [
    (1, "E1", "Jonas Weber", "jonas@n.example.com", "jw", "asks 10.0.0.1"),
    (2, "E2", "Mira Lund", "mira@n.example.com", "ml", "  Sales "),
    (3, "E1", "Jonas Weber", "jonas@n.example.com", "jw", None),
    (4, " ", "Una Kent", "una@n.example.com", "uk", "asks 10.0.0.2"),
]
COLUMNS = "id int, employee_id string, full_name string, email string, login string, note string"


def test_table(spark):
    df = spark.createDataFrame(PEOPLE, COLUMNS)
    settings = V.Settings(anchor_field="employee_id", correlated_fields=("full_name", "email", "login"))
    rows = V.pseudonymise_table(df, ["id"], settings).df.orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("[PERSON_1]", "[PERSON_1]", "[EMAIL_PERSON_1]", "[PERSON_1]", "asks [IP_1]"),
        ("[PERSON_2]", "[PERSON_2]", "[EMAIL_PERSON_2]", "[PERSON_2]", "  Sales "),
        ("[PERSON_1]", "[PERSON_1]", "[EMAIL_PERSON_1]", "[PERSON_1]", None),
        (" ", "[PERSON_3]", "[EMAIL_1]", "[PERSON_4]", "asks 10.0.0.2"),
    ]


def test_table_restores(spark):
    df = spark.createDataFrame(PEOPLE, COLUMNS).drop("id").withColumn("id", F.monotonically_increasing_id())
    result = V.pseudonymise_table(df, ["id"], V.Settings(force_fields=("full_name", "login")), anchor="email", scan=["note"])
    back = V.restore(result.df, ["full_name", "email", "login", "note"], result.registry, ["id"])
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*back.columns).collect()))


def test_whole_cell_name(spark):
    names = spark.createDataFrame([("Weber", "PERSON"), ("Lund", "ORG")], "term string, etype string")
    rows = [(1, "Weber, Al"), (2, "ask Weber about it"), (3, "Lund, Al")]
    df = spark.createDataFrame(rows, "id int, who string")
    out = V.pseudonymise_table(df, ["id"], V.Settings(lexicon=names)).df.orderBy("id").collect()
    assert [r["who"] for r in out] == ["[PERSON_1], Al", "ask [PERSON_1] about it", "[ORG_1], Al"]
    # From 70 % on the cell is one name, even where the type passes through.
    longer = spark.createDataFrame([("Weber, A", "PERSON")], "term string, etype string")
    relaxed = V.Settings(lexicon=longer, redact=True, passthrough_types=("PERSON",))
    whole = V.pseudonymise_table(df, ["id"], relaxed).df.orderBy("id").collect()
    assert [r["who"] for r in whole] == ["[PERSON_1]", "ask Weber about it", "Lund, Al"]


def test_other_types_and_nested_cells(spark):
    df = spark.createDataFrame([(1, 5.5, ["a@b.example.com"], {"k": "10.0.0.1"})], "id int, n double, a array<string>, m map<string,string>")
    row = V.pseudonymise_table(df, ["id"], scan=["a", "m"]).df.first()
    assert row["n"] == 5.5 and row["a"] == '["[EMAIL_1]"]' and row["m"] == '{"k":"[IP_1]"}'


def test_oversized_dictionary_in_tables(spark):
    names = spark.createDataFrame([(f"name{i}x", "PERSON") for i in range(30)], "term string, etype string")
    df = spark.createDataFrame([(i, f"we saw name{i}x today") for i in range(30)], "id int, note string")
    settings = V.Settings(lexicon=names, small_dictionary_terms=0, dictionary_chars=60)
    out = V.pseudonymise_table(df, ["id"], settings).df.orderBy("id").collect()
    assert [r["note"] for r in out] == [f"we saw [PERSON_{i + 1}] today" for i in range(30)]


def test_several_tables_share_tokens(spark):
    a = spark.createDataFrame([(1, "u1"), (2, "u2")], "id int, user_id string")
    b = spark.createDataFrame([(1, "x", "u2"), (2, "y", "u3")], "id int, key string, value string")
    result = V.pseudonymise_tables(
        {"a": V.TableInput(a, ["id"]), "b": V.TableInput(b, ["id"])}, V.Settings(force_fields=("value",))
    )
    assert [r["user_id"] for r in result.outputs["a"].orderBy("id").collect()] == ["[PERSON_1]", "[PERSON_2]"]
    assert [r["value"] for r in result.outputs["b"].orderBy("id").collect()] == ["[PERSON_2]", "[PERSON_3]"]
    c = spark.createDataFrame([("k", "u1")], "id string, user_id string")
    with pytest.raises(ValueError, match="differ in type"):
        V.pseudonymise_tables({"a": V.TableInput(a, ["id"]), "c": V.TableInput(c, ["id"])})


def test_model_hook(spark):
    """A user's own model gives spans by a pandas UDF."""

    @F.pandas_udf("array<struct<etype:string,value:string,start:int,end:int,score:double>>")
    def model(texts):
        def find(t):
            at = t.find("Zed")
            return [] if at < 0 else [{"etype": "PERSON", "value": "Zed", "start": at, "end": at + 3, "score": 0.85}]

        return texts.map(find)

    df = spark.createDataFrame([(1, "Zed wrote to z@b.example.com"), (2, "none")], "id int, text string")
    out = V.pseudonymise_text(df, "text", ["id"], V.Settings(ner=model)).df.orderBy("id").collect()
    assert [r["text"] for r in out] == ["[PERSON_1] wrote to [EMAIL_1]", "none"]


def test_tokens_before_a_run_are_reported(spark):
    df = spark.createDataFrame([(1, "already [PERSON_1] and [x]"), (2, "no")], "id int, text string")
    assert [tuple(r) for r in AUD.existing_tokens(df, "text", ["id"]).collect()] == [(1, "[PERSON_1]")]


def test_hot_values_take_the_broadcast_side(spark):
    """One value in a third of the rows; the lookup counts as too large to broadcast."""
    rows = [(i, "all@hot.example.com" if i % 3 else f"u{i}@a.example.com") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    settings = V.Settings(broadcast_bytes=0)
    result = V.pseudonymise_text(df, "text", ["id"], settings)
    wanted = V.pseudonymise_text(df, "text", ["id"])
    assert sorted(map(tuple, result.df.collect())) == sorted(map(tuple, wanted.df.collect()))
    from veilmark.operators.restore import restore

    back = restore(result.df, ["text"], result.registry, ["id"], bound=0)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_texts_are_searched_once(spark, bound):
    """The plan of the result reads the written spans and holds no detection."""
    df = spark.createDataFrame([(i, f"u{i}@a.example.com" if i % 2 else "none") for i in range(20)], "id int, text string")
    run = V.pseudonymise_text(df, "text", ["id"], V.Settings(broadcast_bytes=bound))
    for frame in (run.df, run.only_hits):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "luhn_check" not in plan and "@[A-Za-z0-9.-]" not in plan
    assert run.df.filter("text = 'none'").count() == 10


def test_names_of_a_table_do_not_clash_with_those_of_a_job(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", "o", "e", 2)], "id int, text string, ord string, entities string, `has hits` int")
    run = V.pseudonymise_text(df, "text", ["id"])
    assert run.df.columns == df.columns and tuple(run.df.first()) == (1, "[EMAIL_1]", "o", "e", 2)
    back = V.restore(run.df, ["text"], run.registry)
    assert tuple(back.first()) == tuple(df.first())


def test_restore_of_rows_that_repeat(spark):
    registry = V.pseudonymise_text(spark.createDataFrame([(1, "a@b.example.com 10.0.0.1")], "id int, text string"), "text", ["id"]).registry
    rows = [(1, "[email_1]", None), (1, "[IP_1] [IP_9]", "x"), (None, "no", "[EMAIL_1][EMAIL_1]"), (None, None, None), (2, "", "[PERSON_1]")]
    df = spark.createDataFrame(rows, "id int, a string, b string").withColumn("n", F.expr("NULL"))
    got = sorted((str((r.id, r.a, r.b)) for r in V.restore(df, ["a", "b"], registry).collect()))
    assert got == sorted(str(r) for r in [
        (1, "a@b.example.com", None), (1, "10.0.0.1 [IP_9]", "x"), (None, "no", "a@b.example.coma@b.example.com"), (None, None, None), (2, "", "[PERSON_1]"),
    ])


def test_rows_of_one_file_are_searched_by_many_tasks(spark, tmp_path):
    """A file of one row group is one task's to read, but its cells are not one task's to search."""
    n = 3 * COMMON.SPREAD_ROWS
    table = spark.range(n).select("id", F.concat(F.lit("mail c"), F.col("id").cast("string"), F.lit("@x.example.com")).alias("note"))
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1
    dealt = COMMON.spread(one)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) * spark.sparkContext.defaultParallelism <= 2 * n
    assert COMMON.spread(dealt).rdd.getNumPartitions() == len(sizes)
    few = one.limit(10)
    assert COMMON.spread(few) is few
    out = V.pseudonymise_table(one, ["id"], scan=["note"]).df
    assert out.filter(F.col("note") == F.concat(F.lit("mail [EMAIL_"), (F.col("id") + 1).cast("string"), F.lit("]"))).count() == n
    text = V.pseudonymise_text(one, "note", ["id"]).df
    assert text.filter(F.col("note") == F.concat(F.lit("mail [EMAIL_"), (F.col("id") + 1).cast("string"), F.lit("]"))).count() == n
