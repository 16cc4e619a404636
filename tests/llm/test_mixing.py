"""Source mixing against a plain model, the evenness of its schedule, and its edge cases."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model(rows, weights=(1, 2, 3), most=3):
    """``(doc_id, size, source_size, target, taken)`` one row after the other."""
    sized = [(i, t or "", s, len(WORD.findall(t or ""))) for i, t, s in rows]
    names = sorted({s for *_, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    words = {s: sum(n for *_, x, n in sized if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(words.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        reached = (total - sum(most * words[s] for s in full)) / rest if rest else 0.0
        now = {s for s in names if most * words[s] <= reached * weight[s]} if rest else full
        if now == full:
            break
        full = now
    target = {s: min(words[s] * float(most), weight[s] * reached) for s in names}
    out = []
    for s in names:
        stream = sorted(
            (r for r in sized if r[2] == s),
            key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest(),
        )
        quota, at = math.floor(target[s]), 0
        for i, _, _, n in stream:
            got = sum(max(0, min(at + e * words[s] + n, quota) - at - e * words[s]) for e in range(most))
            out.append((i, n, words[s], target[s], got))
            at += n
    return sorted(out, key=str)


def sample(seed, n, sources):
    rng = random.Random(seed)
    return [
        (i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 3, 10, 60, 400]))), rng.choice(sources))
        for i in range(n)
    ]


CASES = {
    "plain": sample(1, 120, ["a", "b", "c", "d"]),
    "hot source": sample(2, 150, ["a"] * 9 + ["b", "c", "é", None]),
    "one source": sample(3, 20, ["x"]),
    "no words": [(1, "", "a"), (2, None, "b"), (3, " \t\n", None)],
    "nulls, repeats, long": [(None, "a b c", "s"), (None, "a b c", "s"), (None, None, None), (7, "x " * 5000, None), (7, "x " * 5000, None), (8, "é  ü", "s"), (9, "q", "")],
}


@pytest.mark.parametrize("name", CASES)
def test_taken(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "*", "1 AS size", "2 AS key", "3 AS src", "4 AS slot", "'t' AS turn", "5 AS bits"
    ).repartition(3)
    got = mixing.taken(docs, block_words=16)
    again = mixing.taken(docs.repartition(2), block_words=16)
    plain = sorted((tuple(r) for r in got.collect()), key=str)
    want = model(rows)
    assert [r[:3] + r[4:] for r in plain] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in plain] == pytest.approx([r[3] for r in want])
    assert sorted((tuple(r) for r in again.collect()), key=str) == plain
    assert all(r[4] <= 3 * r[1] for r in plain)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.taken(docs).count() == mixing.mix(docs).count() == 0


def test_mix_is_even_and_whole(spark):
    rows = CASES["hot source"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs, block_words=8).orderBy("slot", "src", "rank", "begin").collect()
    quota = {}
    for i, _, words, target, _ in model(rows):
        quota[words] = math.floor(target)
    blocks = collections.defaultdict(dict)
    for r in found:
        blocks[r.src].setdefault(r.rank, [r.slot, 0])
        blocks[r.src][r.rank][1] += r.n_words
    total = 0
    for ranks in blocks.values():
        assert sorted(ranks) == list(range(len(ranks)))
        assert [n for _, (_, n) in sorted(ranks.items())][:-1] == [8] * (len(ranks) - 1)
        total += sum(n for _, n in ranks.values())
        # Ranks follow the slots.
        slots = [slot for _, (slot, _) in sorted(ranks.items())]
        assert slots == sorted(slots)
    assert total == sum(quota.values())
    # Every stretch of the schedule has the sources in proportion.
    n_slots = sum(map(len, blocks.values()))
    for ranks in blocks.values():
        slots = sorted(slot for slot, _ in ranks.values())
        for upto in range(n_slots // 8, n_slots, n_slots // 8):
            share = sum(s < upto for s in slots)
            assert abs(share - upto * len(ranks) / n_slots) <= 2 + math.log2(n_slots)


def test_running_totals_in_levels(spark):
    rng = random.Random(4)
    rows = [("a" if k % 3 else f"g{k % 40}", rng.randrange(1 << 20), k, rng.randrange(50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, at bigint, k int, v bigint")
    # More leading bits than one level takes.
    bits = F.when(F.col("g") == "a", 13).otherwise(2)
    got = mixing.running(df.withColumn("bits", bits), "g", "at", "20", "bits", 13, "v", ["at", "k"]).collect()
    sums, want = collections.Counter(), {}
    for g, at, k, v in sorted(rows):
        want[k] = sums[g]
        sums[g] += v
    assert {r.k: r.before for r in got} == want


def test_prefix(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 5) for i in range(101)], "a int, v bigint")
    got = {r.a: (r.n, r.s) for r in mixing.prefix(df, ["a"], n="1L", s="v").collect()}
    rows = sorted((i * 37 % 101, i % 5) for i in range(101))
    assert got == {a: (k, sum(v for _, v in rows[:k])) for k, (a, _) in enumerate(rows)}


def test_words_are_counted_without_arrays(spark):
    texts = ["", " ", "a", " a", "a ", " a  b\n\nc\x0b", "é x y", "\x1f a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(F.expr(mixing.count_words("coalesce(t, '')")).alias("n")).collect()]
    assert got == [len(WORD.findall(t or "")) for t in texts]
