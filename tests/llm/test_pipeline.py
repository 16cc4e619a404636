"""The corpus pipeline, stage by stage, against plain models of what each stage keeps."""

import collections
import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veilmark.llm import near_dedup
from veilmark.llm.common import shared_folder
from veilmark.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
POOL = [f"word{i}" for i in range(4000)]
PASSAGE = " ".join(f"passage{i}" for i in range(60))
SHAPE = "doc_id bigint, text string, source string, h int, node string, kept int"


def prose(n):
    return " ".join(RNG.choice(POOL) for _ in range(n))


def sample():
    texts = [prose(RNG.choice([30, 80, 400])) for _ in range(30)] + [prose(2500)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    # Exact copies, a near copy of each of some, and a passage that several documents share.
    rows += [(100 + i, texts[i], "s0") for i in range(6)] + [(100, texts[0], "s0")]
    rows += [(200 + i, texts[i] + " one more", "s1") for i in range(3, 9) if len(texts[i].split()) > 60]
    rows += [(300 + i, f"{prose(40)} {PASSAGE} {prose(40)}", "s2") for i in range(4)]
    # Too short, repeated words, nothing, no id; and a host that fails as a whole.
    rows += [(400, "too short", "s0"), (401, "a b c d e f g h " * 20, "s1"), (402, "", None), (403, None, None), (None, prose(50), "s0")]
    rows += [(500 + i, "junk", "bad") for i in range(60)] + [(560, prose(60), "bad")]
    return [(*r, 1, "n", 2) for r in rows]


def shingles(text):
    ws = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def near_kept(rows):
    sets, top = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}, {}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i in ids:
        top[i] = find(i)
    return [r for r in rows if r[0] is None or top[r[0]] == r[0]]


def cleaned(rows, size=400):
    raws = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(b[s : s + size] for b in raws for s in range(len(b) - size + 1))
    out = []
    for r, raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for s in range(len(raw) - size + 1):
            if seen[raw[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        out.append((r[0], bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_stages(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    columns = frame.columns
    held, names = {}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "suffix-array dedup", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = shared_folder(spark, "stage")
        stage(spark, frame, "").write.parquet(path)
        frame = spark.read.parquet(path)
        assert k == 4 or frame.columns == columns
        held[name] = rows_of(frame)

    # Clean documents stay, failing ones and those of the failing host go.
    quality = held["quality rules"]
    assert {r[0] for r in rows} - {r[0] for r in quality} == {400, 401, 402, 403, *range(500, 561)}
    best = collections.defaultdict(list)
    for r in quality:
        best[r[1]].append(r)
    exact = sorted((max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in best.values()), key=str)
    assert held["exact dedup"] == exact
    near = sorted(near_kept(exact), key=str)
    assert held["near dedup"] == near and len(near) < len(exact)
    repeats = sorted(cleaned(near), key=str)
    got = held["suffix-array dedup"]
    assert sorted(((r[0], r[1].encode()) for r in got), key=str) == repeats
    assert sum(PASSAGE[:200] in r[1] for r in got) == 0

    encode = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = collections.Counter()
    for r in got:
        ids = [*encode.encode(r[1], add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r[0], piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    packed = frame.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) <= -(-sum(r.length for r in packed) // 2048) + 1


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1, "n", 2), (None, "", "s", 1, "n", 2)]])
def test_nothing_left(spark, rows):
    frame = spark.createDataFrame(rows, SHAPE)
    for _, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, "stage")
        stage(spark, frame, "").write.parquet(path)
        frame = spark.read.parquet(path)
    assert frame.count() == 0


def test_rows_to_drop_are_met_by_id_and_text(spark):
    """Rows that repeat the id of a dropped one with another text stay."""
    text = prose(80)
    rows = [(1, text, "a"), (2, text + " x", "a"), (2, prose(80), "b"), (None, text, "c"), (2, text + " x", "d")]
    kept = near_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted(r.source for r in kept) == ["a", "b", "c"]
