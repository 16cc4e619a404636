"""Periodic runs against brute force on random words, on planted documents, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest import SF
from veilmark.llm import periodic
from veilmark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, least):
    """All runs by trying every period."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts(seed, n):
    rng = random.Random(seed)
    yield from (fibonacci(k) for k in (20, 89, 233))
    # Two progressions of one step side by side: a run for every odd period.
    yield list("ab" * 20 + "a" + "ab" * 20 + "a")
    yield list("aab" * 9 + "a" + "aab" * 9 + "aba" * 7)
    yield ["x"] * 70
    for _ in range(n):
        kinds = rng.choice(["a", "ab", "ab", "abc", "abcd"])
        x = [rng.choice(kinds) for _ in range(rng.choice([0, 1, 12, 40, 70]))]
        block = [rng.choice("ab") for _ in range(rng.randint(1, 9))]
        yield x[:15] + block * rng.randint(1, 5) + block[: rng.randint(0, 9)] + x[15:]


@pytest.mark.parametrize("least", [2, 3, 12, 17])
def test_runs_are_those_of_brute_force(least):
    cases = list(texts(least, 700))
    for k in range(0, len(cases), 6):
        some = cases[k : k + 6]
        names, begins = periodic.name_words([[w.encode() for w in x] for x in some])
        got = [tuple(map(int, r)) for r in zip(*periodic.find_runs(names, least))]
        assert got == [(int(b) + s, m, q) for x, b in zip(some, begins) for s, m, q in brute(x, least)]


def test_long_texts_of_one_word_and_of_one_block():
    for x, want in (([b"x"] * 100_000, 1), ([b"%d" % (i % 1777) for i in range(100_000)], 1777)):
        names, _ = periodic.name_words([x])
        assert [tuple(map(int, r)) for r in zip(*periodic.find_runs(names))] == [(0, 100_000, want)]


def model(doc_id, text):
    ws = WORD.findall(text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute(ws, 12) if n < 3000 else None
    return ws, runs


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    ws, runs = model(doc_id, text)
    if runs is None:
        return None
    gone = {j for s, m, q in runs for j in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *shown, digest(listed), digest(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_query_is_that_of_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(docs)
    checked = 0
    for r in rows:
        want = expected(r.doc_id, docs[r.doc_id])
        if want is not None:
            assert tuple(r)[:8] == want
            checked += want[1] > 0
    assert checked > 5


CASES = [
    (1, "a b " * 6), (1, "a b " * 6), (None, "x " * 12), (2, None), (3, ""), (4, " \t\n"), (5, "x " * 11),
    (6, "é ü z " * 7), (7, "one two three"), (8, "w " * 5000 + " ".join(map(str, range(3000)))),
]


def test_defined_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id bigint, text string").selectExpr(
        "1 AS runs", "*", "'k' AS collapsed", "2 AS start", "3 AS n_words"
    ).repartition(3)
    got = sorted((tuple(r) for r in periodic.digests(periodic.runs(docs)).collect()), key=str)

    def plain(doc_id, text):
        ws = WORD.findall(text or "")
        runs = brute(ws, 12) if len(ws) < 5000 else [(0, 5000, 1)]
        return runs, [w for i, w in enumerate(ws) if not any(s + q <= i < s + m for s, m, q in runs)]

    want = []
    for doc_id, text in CASES:
        runs, left = plain(doc_id, text)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *shown, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(left))))
    assert got == sorted(want, key=str)

    clean = periodic.collapse(docs)
    assert clean.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in clean.collect()}
    assert {(1, "a b"), (2, None), (4, " \t\n"), (7, "one two three"), (None, "x")} <= kept
    none = docs.limit(0)
    assert periodic.digests(periodic.runs(none)).count() == periodic.collapse(none).count() == 0
    assert periodic.digests(periodic.runs(periodic.plant(none))).count() == 0


def test_planted_documents(spark):
    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS w", "2 AS g", "3 AS a", "4 AS p")
    got = [(r.doc_id, WORD.findall(r.text or "")) for r in periodic.plant(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, model(i, t)[0]) for i, t in rows), key=str)


def test_kept_words():
    flags = periodic.kept_words(10, np.array([0, 2]), np.array([4, 8]), np.array([2, 3]))
    assert flags.tolist() == [True, True, False, False, True, False, False, False, False, False]
