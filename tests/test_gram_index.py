"""The rare-gram index against a plain search for every term."""

import random

import pytest
from pyspark.sql import functions as F

import veilmark as V
from veilmark.operators import dictionary as D
from veilmark.operators import gram_index as G


def brute(texts, terms):
    """``(id, term, etype, value, start)``; a term never overlaps itself."""
    kinds = {}
    for term, etype, _ in terms:
        kinds.setdefault(G.fold(term), set()).add(etype)
    out = []
    for i, text in texts:
        low = G.fold(text or "")
        for term, etypes in kinds.items():
            at = low.find(term)
            while at >= 0:
                out += [(i, e, text[at : at + len(term)], at) for e in etypes]
                at = low.find(term, at + len(term))
    return sorted(out, key=str)


def searched(spark, texts, terms, n=None):
    docs = spark.createDataFrame(texts, "id int, text string").selectExpr("*", "1 AS _row", "2 AS gram", "3 AS spans").repartition(3)
    table = G.index(spark.createDataFrame(terms, "term string, etype string, score string").repartition(2))
    found = G.search(docs, ["id"], "text", table, n or len(terms))
    rows = found.select("id", F.inline("spans"))
    return sorted(((r.id, r.etype, r.value, r.start) for r in rows.collect()), key=str)


def test_random_terms(spark):
    rng = random.Random(7)
    letters = "abAB éßİ\U0001F600"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 5, 40, 300]))) for i in range(60)] + [(60, None), (60, "ab ab"), (60, "ab ab")]
    terms = [(word(rng.choice([1, 2, 3, 4, 5, 8, 9, 17])), rng.choice(["COMPANY", "PERSON"]), "0.99") for _ in range(60)]
    want = brute(texts, terms)
    assert len(want) > 500
    assert searched(spark, texts, terms) == want
    # A filter that is far too small lets more places through and changes nothing.
    assert searched(spark, texts, terms, 1) == want


def test_hot_and_long_terms(spark):
    long = "long company name " * 30
    terms = [("the", "ORG", "0.85"), ("THE", "ORG", "0.85"), (long, "COMPANY", "0.99"), ("aaaa", "COMPANY", "0.99")]
    texts = [(i, "The other " * 20 + ("a" * 11)) for i in range(40)] + [(40, "x" + long.upper() + long)]
    assert searched(spark, texts, terms) == brute(texts, terms)


def test_no_terms_and_no_texts(spark):
    assert searched(spark, [(1, "a b")], [("zz", "ORG", "0.85")]) == []
    assert searched(spark, [], [("zz", "ORG", "0.85")]) == []


def test_large_dictionary_has_no_array_column(spark):
    names = spark.createDataFrame([(f"name{i}x",) for i in range(30)], "term string")
    dictionary = D.load(spark, V.Settings(company_terms=names, small_dictionary_terms=0, dictionary_chars=20))
    assert not dictionary.in_row and dictionary.n_terms == 30
    with pytest.raises(ValueError, match="index"):
        D.spans("text", dictionary)


def test_gram_of_a_term_is_the_rarest(spark):
    terms = [("common-alpha", "ORG", "1"), ("common-beta", "ORG", "1"), ("common-gamma", "ORG", "1"), ("ab", "ORG", "1")]
    rows = {r.term: r for r in G.index(spark.createDataFrame(terms, "term string, etype string, score string")).collect()}
    assert rows["common-beta"].size == 8 and rows["ab"].size == 2
    # The first grams of the three are shared, later ones are not.
    assert all(rows[t].off + 8 > len("common-") for t in ("common-alpha", "common-beta", "common-gamma"))
    assert G.cells_of(1) == 1 << 10 and G.cells_of(1 << 40) == G.MAX_CELLS


def test_work_is_bounded_by_characters_not_rows():
    import numpy as np
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * (G.CHUNK_CHARS + 5), "", "c" * 7] + ["dé" * 5000] * 400
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts])], names=["_keep", "_text"])
    parts = list(G._chunks(batch, 1))
    assert [t for _, (folded,) in parts for t in folded] == [t or "" for t in texts]
    assert all(len(f) == 1 or sum(len(t.encode()) for t in f) <= G.CHUNK_CHARS for _, (f,) in parts) and len(parts) > 5
    # Grams of joined texts never reach from one into the next.
    letters, first, lengths = G.joined(["abcd", "", "x", "efghi"])
    at, row = G.places(first, lengths, 4)
    assert at.tolist() == [0, 5, 6] and row.tolist() == [0, 3, 3] and len(letters) == 10
    assert np.array_equal(G.gram_hashes(letters, 4)[at[1:]], G.gram_hashes(G.codes("efghi"), 4))
    assert G.places(first, lengths, 4, lengths == 5)[1].tolist() == [3, 3]


def test_grams_of_all_terms_are_found(spark):
    terms = [(f"name {i:05d} of firm", "ORG", "0.85") for i in range(300)] + [(f"n{i}x", "PERSON", "0.99") for i in range(300)]
    texts = [(i, f"{'filler ' * (i % 9)}Name {i:05d} OF firm and n{i}x") for i in range(300)]
    assert searched(spark, texts, terms) == brute(texts, terms)
