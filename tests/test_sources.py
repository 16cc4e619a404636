import collections
import csv
import io
import json
import os
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import veilmark as V
from veilmark.operators.roster import RosterError
from veilmark.sources import files as FILES
from veilmark.sources import tables as T
from veilmark.sources.html import html_text
from veilmark.sources.mail import read_mail
from veilmark.sources.text import read_texts, write_texts
from veilmark.streaming.stream import bucket_of, pseudonymise_stream, wanted_buckets


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


@pytest.mark.parametrize(
    "lines, skip, header",
    [
        (["a,b", "1,2"], 0, ["a", "b"]),
        (["Report", "x,y", "a,b,c", "1,2,3"], 2, ["a", "b", "c"]),
        (['"two\nlines"', "a,b"], 2, ["a", "b"]),
        ([], 0, []),
    ],
)
def test_header_sniff(lines, skip, header):
    assert T.header_of([part + "\n" for line in lines for part in line.split("\n")]) == (skip, header)


def test_csv(spark, tmp_path):
    put(tmp_path, "a.csv", '﻿name,n,note\nAnn,007,"x, ""y"""\nNA,,nan\n')
    rows = T.read_csv(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("Ann", "007", 'x, "y"'), ("NA", None, "nan")]
    assert T.columns(spark, str(tmp_path)) == ["name", "n", "note"]
    put(tmp_path / "p", "b.csv", 'Made today\nby,us\n\nname,n,note\nAnn,1,"x, ""y"""\n\nBob,2,z\nname,n,note\n')
    rows = T.read_csv(spark, str(tmp_path / "p"), position=True).orderBy("_line").collect()
    assert [tuple(r)[3:] for r in rows] == [("Ann", "1", 'x, "y"'), ("Bob", "2", "z"), ("name", "n", "note")]
    put(tmp_path / "p", "c.csv", "other\n1\n")
    with pytest.raises(T.TableError):
        T.read_csv(spark, str(tmp_path / "p"))


def test_csv_blocks(spark, tmp_path):
    """Small blocks: the preamble is dropped from the first block only."""
    body = "".join(f"{i},v{i}\n" for i in range(2000))
    put(tmp_path, "a.csv", "preamble\nk,v\n" + body)
    rows = T.read_csv(spark, str(tmp_path), position=True, block_bytes=4096)
    assert rows.select("_block").distinct().count() > 2
    assert [r["k"] for r in rows.orderBy("_block", "_line").collect()] == [str(i) for i in range(2000)]


def test_line_breaks_in_quotes(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,note\n1,"call\nq@x.example.com now"\n2,"a ""b""\r\n,c"\r\n3,5" disk\n4,"x"\n')
    rows = T.read_csv(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "call\nq@x.example.com now"), ("2", 'a "b"\r\n,c'), ("3", '5" disk'), ("4", "x")]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1000])
def test_records_that_cross_blocks(spark, tmp_path, block):
    """Random cells with quotes, commas and line breaks, against the standard reader."""
    rng = random.Random(block)
    for k in range(4):
        text = "".join(rng.choice('ab,"\n') for _ in range(rng.choice([0, 30, 300])))
        put(tmp_path, f"r{k}.csv", text)
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([[rng.choice(["", "a", 'x"y', "1,2", "two\nlines", "\n"]) for _ in range(3)] for _ in range(40)])
        put(tmp_path, f"w{k}.csv", out.getvalue())
    records, errors = T.csv_records(FILES.list_files(spark, str(tmp_path)), block)
    got, bad = collections.defaultdict(list), {os.path.basename(r.path): r.error for r in errors.collect()}
    for r in records.orderBy("path", "block", "line").collect():
        got[os.path.basename(r.path)].append(list(r.cells))
    for path in tmp_path.iterdir():
        text = path.read_text()
        inside = False
        for line in text.split("\n"):
            inside = T.ends_inside(line, inside)
        assert bad.get(path.name) == (T.UNCLOSED if inside else None)
        if not inside:
            want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
            # Records of blanks alone are left out.
            told = lambda r: len(r) > 1 or r[0].strip()
            assert list(filter(told, got[path.name])) == list(filter(told, want))


def test_ends_inside():
    assert [T.ends_inside(s, False) for s in ('a,"b', '"a""', '"a"",b', 'a"b', '"a"b"c', "", 'x,""', '"')] == [
        True, True, True, False, False, False, False, True,
    ]
    assert [T.ends_inside(s, True) for s in ('b"', 'b""', "b", '",",', '",a"b', '","x')] == [False, True, True, True, False, True]


def test_names_that_repeat():
    assert T.distinct_names(["a", "a", "b", "a", "a.1"]) == ["a", "a.2", "b", "a.3", "a.1"]


def test_listing_sees_every_file(spark, tmp_path):
    for name in ("_h.txt", "e.txt", "sub/_x/deep.TXT", "with blank.txt"):
        put(tmp_path, name, "")
    flat = {r.name: (r.suffix, r.length) for r in FILES.list_files(spark, str(tmp_path)).collect()}
    assert flat == {"_h.txt": (".txt", 0), "e.txt": (".txt", 0), "with blank.txt": (".txt", 0)}
    every = {r.path for r in FILES.list_files(spark, str(tmp_path), True).collect()}
    assert f"file:{tmp_path}/sub/_x/deep.TXT" in every and len(every) == 4
    assert FILES.list_files(spark, f"file://{tmp_path}/e.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        FILES.list_files(spark, str(tmp_path / "missing"))


def test_write_table_keeps_order_and_letters(spark, tmp_path):
    df = spark.createDataFrame([("ü", "1")], "z string, a string")
    T.write_table(df, str(tmp_path / "out"), ["z", "a"], "json")
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert text.strip() == '{"z":"ü","a":"1"}'


def test_roster(spark, tmp_path):
    path = put(tmp_path, "r.csv", " Full_Name ,EMAIL,Team\n Ann Lee ,a@b.c,x\n,b@b.c,y\nBob,  ,z\n")
    rows = T.read_roster(spark, path).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [("Ann Lee", "a@b.c", None), ("Bob", None, None)]
    with pytest.raises(RosterError):
        T.read_roster(spark, put(tmp_path / "bad", "r.csv", "name\nx\n"))


class Data(HTMLParser):
    def handle_data(self, data):
        self.__dict__.setdefault("found", []).append(data)


def parsed(html):
    parser = Data()
    parser.feed(html)
    parser.close()
    return " ".join(parser.__dict__.get("found", []))


HTML = [
    "<p>Hi<b>you</b></p><script>var x;</script>&amp; all", "just text", "", "a < b <i>c</i>", '<p title="x>y">z</p>',
    "<!DOCTYPE html><!-- a <b> c -->x<br/>y<?php z ?>w", "<style>p{a:b}</style><STYLE>i>b</STYLE>q",
    "<script>if (a<b) {t='<p>';}</script>end", "&#233;&#x1F600;&eacute;&nope;&lt;b&gt;", "<div\n class='a'\n>line\nbreak</div>",
]


def test_html(spark):
    df = spark.createDataFrame([(h,) for h in [*HTML, None]], "h string")
    got = [r[0] for r in df.select(html_text("h")).collect()]
    assert got == [*map(parsed, HTML), None]


def test_html_of_any_length(spark):
    long = "<p>" + "word " * 200_000 + "</p><a href='" + "x" * 500_000 + "'>y</a>" + "<" * 1000
    df = spark.createDataFrame([(long,)], "h string")
    assert df.select(html_text("h")).first()[0] == "word " * 200_000 + " y " + " ".join("<" * 1000)


MAIL = """From: Ann <ann@x.example.com>
To: bob@x.example.com
Cc:
Subject: Hello
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b1"

--b1
Content-Type: {first}; charset=utf-8

{body}
--b1
Content-Type: text/html; charset=utf-8

<p>html <i>part</i></p>
--b1--
"""
HEAD = "From: Ann <ann@x.example.com>\nTo: bob@x.example.com\nSubject: Hello"


def test_mail(spark, tmp_path):
    put(tmp_path, "plain.eml", MAIL.format(first="text/plain", body="plain part"))
    put(tmp_path, "html.eml", MAIL.format(first="application/x", body="zz"))
    put(tmp_path, "simple.eml", "Subject: s\n\njust text\n")
    put(tmp_path, "onlyhtml.eml", "Content-Type: text/html\n\n<p>a</p><p>b</p>\n")
    put(tmp_path, "nothing.eml", "X-Other: 1\n\n \n")
    put(tmp_path, "skip.txt", "no mail")
    rows = {os.path.basename(r["path"]): r for r in read_mail(spark, str(tmp_path)).collect()}
    assert rows["plain.eml"]["text"] == HEAD + "\n\nplain part"
    assert rows["html.eml"]["text"].split("\n\n", 1)[1].split() == ["html", "part"]
    assert rows["simple.eml"]["text"] == "Subject: s\n\njust text\n"
    assert rows["onlyhtml.eml"]["text"].split() == ["a", "b"]
    assert rows["nothing.eml"]["error"] and rows["nothing.eml"]["text"] is None
    assert len(rows) == 5


def test_texts(spark, tmp_path):
    put(tmp_path, "a.txt", b"caf\xff\nline")
    assert read_texts(spark, str(tmp_path)).first()["text"] == "caf�\nline"
    df = spark.createDataFrame([(f"file:{tmp_path}/o/x.txt", "hällo"), ("nofs://x/y", "z")], "output string, text string")
    os.makedirs(tmp_path / "o")
    errors = {r["output"]: r["error"] for r in write_texts(df).collect()}
    assert (tmp_path / "o" / "x.txt").read_text("utf-8") == "hällo"
    assert errors["nofs://x/y"] and errors[f"file:{tmp_path}/o/x.txt"] is None


def make_folder(tmp_path):
    put(tmp_path, "a.txt", "Card 4111111111111111, mail a@b.example.com")
    put(tmp_path, "b.csv", "Report\nname,email\nAnn Lee,a@b.example.com\n")
    put(tmp_path, "c.eml", "From: c@b.example.com\n\ncall 555-234-5678\n")
    put(tmp_path, "d.json", json.dumps([{"user": "u1", "n": 5, "mail": "d@b.example.com"}]))
    put(tmp_path, "bad.json", "{oops")
    put(tmp_path, "w.docx", b"not a document")
    put(tmp_path, "x.redacted.txt", "done before")
    put(tmp_path, ".hidden.txt", "hidden")
    put(tmp_path, "y.png", b"1")
    put(tmp_path, "sub/z.txt", "e@b.example.com")


def test_discovery(spark, tmp_path):
    make_folder(tmp_path)
    names = {r["name"] for r in FILES.discover(spark, str(tmp_path)).collect()}
    assert names == {"a.txt", "b.csv", "c.eml", "d.json", "bad.json", "w.docx"}
    assert "z.txt" in {r["name"] for r in FILES.discover(spark, str(tmp_path), True).collect()}


def test_redact_folder(spark, tmp_path):
    make_folder(tmp_path)
    result = V.redact_folder(spark, str(tmp_path), recursive=True)
    texts = {os.path.basename(r["path"]): (os.path.basename(r["output"]), r["text"]) for r in result.texts.collect()}
    assert texts["a.txt"] == ("a.redacted.txt", "Card 411111XXXXXX1111, mail [EMAIL_1]")
    assert texts["c.eml"] == ("c.redacted.txt", "From: [EMAIL_2]\n\ncall [PHONE_1]\n")
    assert texts["z.txt"][1] == "[EMAIL_4]"
    assert tuple(result.table(["name", "email"]).first())[3:] == ("1_A.L.", "[EMAIL_1]")
    row = result.table(["user", "n", "mail"]).first()
    assert (row["user"], row["n"], row["mail"]) == ("2_U.", "5", "[EMAIL_3]")
    lines = {os.path.basename(r["output"]): r["text"] for r in result.lines().collect()}
    assert lines == {"b.redacted.csv": "1_A.L.,[EMAIL_1]", "d.redacted.json": '{"user":"2_U.","n":"5","mail":"[EMAIL_3]"}'}
    errors = {os.path.basename(r["path"]): r["error"] for r in result.files.collect()}
    assert errors["w.docx"] and errors["bad.json"] and errors["a.txt"] is None
    assert tuple(result.summary().first()) == (7, 5, 2)


def shown(result):
    """Rewritten rows by file name."""
    out = collections.defaultdict(list)
    for r in result.rows.orderBy("path", "_block", "_line").collect():
        out[os.path.basename(r["path"])].append(dict(zip(r["names"], r["texts"])))
    return dict(out)


def test_files_of_a_folder_keep_their_own_columns(spark, tmp_path):
    """A column of one file is no anchor of another: rows without it are still scanned."""
    put(tmp_path, "a.json", json.dumps([{"user_id": "u1", "email": "a@x.example.com"}, {"user_id": None, "email": "kept@x.example.com"}]))
    put(tmp_path, "b.json", '{"email": "leak@x.example.com", "big": 12345678901234567890, "x": {"a": [1.50, true, null, "é"]}}')
    put(tmp_path, "c.csv", "id,note,note\n1,see c@x.example.com,d@x.example.com\n")
    put(tmp_path, "d.csv", "a,b\n" + "1,2\n" * 30 + "1,2,3\n")
    put(tmp_path, "e.csv", "")
    put(tmp_path, "f.json", "[]")
    put(tmp_path, "g.json", '[1, 2]')
    put(tmp_path, "_h.txt", "mail h@x.example.com")
    put(tmp_path, "i.txt", "")
    result = V.redact_folder(spark, str(tmp_path))
    rows = shown(result)
    assert rows["a.json"] == [{"user_id": "1_U.", "email": "[EMAIL_2]"}, {"user_id": None, "email": "kept@x.example.com"}]
    assert rows["b.json"] == [{"email": "[EMAIL_3]", "big": "12345678901234567890", "x": '{"a":[1.50,true,null,"é"]}'}]
    assert rows["c.csv"] == [{"id": "1", "note": "see [EMAIL_4]", "note.1": "[EMAIL_5]"}]
    texts = {os.path.basename(r["path"]): r["text"] for r in result.texts.collect()}
    assert texts == {"_h.txt": "mail [EMAIL_1]", "i.txt": ""}
    errors = {os.path.basename(r["path"]): r["error"] for r in result.files.collect()}
    assert errors["d.csv"] == "a record has 3 cells, the header 2" and errors["e.csv"] == T.NO_COLUMNS
    assert errors["g.json"] == T.BAD_JSON and errors["f.json"] is None
    assert tuple(result.summary().first()) == (9, 6, 3), errors


def test_correlated_cells_and_policies_in_a_folder(spark, tmp_path):
    put(tmp_path, "a.csv", "Employee_ID,login,email,note\nE1,jw,j@x.example.com,asks 10.0.0.1\nE2,ml,m@x.example.com,ok\n ,uk,u@x.example.com,10.0.0.2\n")
    put(tmp_path, "b.json", json.dumps([{"login": "jw", "who": "E2", "say": "jw and j@x.example.com"}]))
    settings = V.Settings(correlated_fields=("email", "login"), force_fields=("who",), masking_rules={"CREDIT_CARD": {}})
    for bound in (0, 32 << 20):
        rows = shown(V.redact_folder(spark, str(tmp_path), settings.with_(broadcast_bytes=bound)))
        assert rows["a.csv"] == [
            {"Employee_ID": "[PERSON_1]", "login": "[PERSON_1]", "email": "[EMAIL_PERSON_1]", "note": "asks [IP_1]"},
            {"Employee_ID": "[PERSON_2]", "login": "[PERSON_2]", "email": "[EMAIL_PERSON_2]", "note": "ok"},
            {"Employee_ID": " ", "login": "[PERSON_3]", "email": "[EMAIL_1]", "note": "10.0.0.2"},
        ]
        assert rows["b.json"] == [{"login": "jw", "who": "[PERSON_2]", "say": "jw and [EMAIL_PERSON_1]"}]


def test_empty_folder(spark, tmp_path):
    result = V.redact_folder(spark, str(tmp_path))
    assert tuple(result.summary().first()) == (0, 0, 0)
    assert result.texts.count() == result.rows.count() == result.lines().count() == 0


def test_stream_keeps_tokens(spark, tmp_path):
    source, out, registry = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "registry")
    source.mkdir()
    schema = "id bigint, text string"

    def feed(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{n}"))

    def drain():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        query = pseudonymise_stream(stream, "text", ["id"], registry, out, str(tmp_path / "state"))
        assert query.awaitTermination(300)

    feed(1, [(1, "a@b.example.com")])
    drain()
    feed(2, [(2, "c@b.example.com and a@b.example.com")])
    drain()
    rows = {r["id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert rows == {1: "[EMAIL_1]", 2: "[EMAIL_2] and [EMAIL_1]"}
    assert spark.read.parquet(registry).count() == 2


def test_batches_read_their_own_buckets(spark):
    names = spark.createDataFrame([("Ann Lee", "person"), ("Bo", "person")], "value string, kind string").withColumns(
        {"anchor": F.lit(None).cast("string"), "seq": F.expr("struct(0 AS sub)")}
    )
    got = wanted_buckets(names, 1 << 20)
    values = spark.createDataFrame([(v,) for v in ("Ann Lee", "Ann", "Lee", "Bo")], "value string")
    assert got == sorted(r.b for r in values.select(bucket_of("value", 1 << 20).alias("b")).collect())


def test_stream_of_many_batches_equals_one_run(spark, tmp_path):
    """Names, their parts and repeats over five batches, against the whole at once."""
    names = spark.createDataFrame([(f"Ann{i} Lee{i % 3}", "PERSON") for i in range(10)], "term string, etype string")
    settings = V.Settings(lexicon=names)
    rows = [(i, f"Ann{i % 10} Lee{i % 10 % 3} wrote to u{i % 7}@x.example.com") for i in range(25)]
    schema = "id bigint, text string"
    for k in range(5):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        run = pseudonymise_stream(
            stream, "text", ["id"], str(tmp_path / "reg"), str(tmp_path / "out"), str(tmp_path / "state"), settings, buckets=8
        )
        assert run.awaitTermination(300)
    want = V.pseudonymise_text(spark.createDataFrame(rows, schema), "text", ["id"], settings)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.df.collect()))
    stored = spark.read.parquet(str(tmp_path / "reg"))
    assert {(r.value, r.token) for r in stored.collect()} == {(r.value, r.token) for r in want.registry.collect()}
