"""Line dedup: sketches, lists of entries and cleaned documents against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from veilmark.llm import line_dedup as L

COLUMNS = "doc_id bigint, h string, text string, lines int"


def alike(x, y):
    return 10 * len(x & y) >= 9 * len(x | y)


def corpus(seed=4):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(60):
        ls = ["", "too few words", "  "]
        for _ in range(4):
            at = int(rng.integers(6)) * 10
            ws = base[at : at + 11 + 10 * int(rng.integers(3))]
            for _ in range(int(rng.integers(3))):
                ws = [*ws]
                ws[rng.integers(len(ws))] = f"n{rng.integers(200)}"
            ls.append(" ".join(rng.permutation(ws)))
        rows.append((k, "h", "\n".join(ls[i] for i in rng.permutation(len(ls))), 1))
    rows += [(None, None, rows[0][2], None), (90, "h", None, 1), (91, "h", "", 1), (92, "h", " ".join(base) * 3000, 1)]
    return rows + [rows[5]]


def expected(rows):
    """Text left per row, and the same for equal rows."""
    seen, out = [], {}
    for i, _, t, _ in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        left = []
        for line in (t or "").split("\n"):
            s = set(line.split())
            if len(s) >= L.MIN_TOKENS:
                if any(alike(s, o) for o in seen):
                    seen.append(s)
                    continue
                seen.append(s)
            left.append(line)
        out[i] = None if t is None else "\n".join(left)
    return out


def test_clean(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = L.clean(frame)
    assert got.columns == frame.columns
    want = expected(rows)
    got = sorted(((r.doc_id, r.h, r.text, r.lines) for r in got.collect()), key=str)
    assert got == sorted(((i, h, want[i], n) for i, h, _, n in rows), key=str)
    assert sum(want[i] != t for i, _, t, _ in rows) > 20
    assert L.clean(frame.limit(0)).count() == 0


def test_sketches():
    rng = np.random.default_rng(1)
    found = [[b"v%d" % v for v in rng.integers(0, 25, rng.integers(5, 40))] for _ in range(200)]
    rarity = rng.integers(0, 50, L.CELLS)
    part, digest, n, lo, hi, prefix = L._sketches([w for ws in found for w in ws], [len(ws) for ws in found], rarity)
    sets = [set(L.token_hashes(ws).tolist()) for ws in found]
    assert part.tolist() == [k for k, s in enumerate(sets) if len(s) >= L.MIN_TOKENS]
    for k, d, size, a, b, p in zip(part, *(c.to_pylist() for c in (digest, n, lo, hi, prefix))):
        s = sets[k]
        assert size == len(s) and d == hashlib.blake2b(np.array(sorted(s), np.uint64).tobytes(), digest_size=16).digest()
        ranked = sorted(s, key=lambda t: (rarity[t & (L.CELLS - 1)], t))
        assert [x % 2**64 for x in p] == ranked[: size - -(-9 * size // 10) + 1]
        bits = 0
        for t in s:
            bits ^= 1 << ((t >> 50) & 127)
        assert (a % 2**64) | (b % 2**64) << 64 == bits


@pytest.mark.parametrize("short", [2, 5, 48])
@pytest.mark.parametrize("every", [False, True])
def test_lists_of_entries(monkeypatch, short, every):
    monkeypatch.setattr(L, "SHORT", short)
    monkeypatch.setattr(L, "MATRIX", 64)
    rng = np.random.default_rng(short)
    m = 600
    v = {c: rng.integers(0, top, m) for c, top in (("token", 25), ("i", 2), ("n", 12), ("pos", 2), ("d", 40), ("own", 2))}
    v |= {"n": v["n"] % 3 + 25, "j": v["i"] + rng.integers(0, 2, m), "h": rng.integers(-5, 5, m), "l": np.arange(m), "g": np.ones(m, int)}
    v |= {c: (np.uint64(1) << rng.integers(0, 3, m).astype(np.uint64)) for c in ("lo", "hi")}
    v |= {"node": rng.permutation(m), "wanted": rng.random(m) < 0.7}
    a, b = L._partners(v, every)
    rows = [{c: x[k].item() for c, x in v.items()} for k in range(m)]
    lists = defaultdict(list)
    for r in rows:
        lists[r["token"], r["i"], r["j"]].append(r)
    want = []
    for (_, i, j), group in lists.items():
        group.sort(key=lambda r: (r["g"], r["d"], r["h"], r["l"]))
        for k, y in enumerate(group):
            mine = []
            for x in group[:k] if y["wanted"] else ():
                need = -(-9 * (x["n"] + y["n"]) // 19)
                room = min(x["n"] - x["pos"], y["n"] - y["pos"]) >= need and (i == j or x["own"] != y["own"])
                differ = (x["lo"] ^ y["lo"]).bit_count() + (x["hi"] ^ y["hi"]).bit_count()
                if room and differ <= x["n"] + y["n"] - 2 * need:
                    mine.append((x["node"], y["node"]))
            want += mine if every else mine[:1]
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(want) and len(want) > 100


def test_text_tokens():
    rng = np.random.default_rng(6)
    ws = [bytes(rng.integers(33, 256, rng.integers(1, 70)).astype(np.uint8)) for _ in range(800)]
    text = b"".join(w + b" \t\n\x0b\x0c\r"[k % 6 : k % 6 + 1 + k % 3] + b"\r" for k, w in enumerate(ws))
    at, h = L.text_tokens(b"\n" + text)
    assert h.tolist() == [xxhash.xxh64_intdigest(w, 42) for w in ws]
    assert [text[a - 1 : a - 1 + len(w)] for a, w in zip(at.tolist(), ws)] == ws
    texts = ["", "a b c d e\n\nf a b c d e a", " ", "é b c d e f\nx", "a b c d\n" * 3]
    row, number, n, tokens, words = L.line_sets(texts)
    assert list(zip(row.tolist(), number.tolist(), n.tolist())) == [(1, 0, 5), (1, 2, 6), (3, 0, 6)]
    assert len(tokens) == 17 and len(words) == 5 + 7 + 7 + 12
    assert tokens[5:11].tolist() == sorted(L.token_hashes([b"f", b"a", b"b", b"c", b"d", b"e"]).tolist())


def test_signatures_meet():
    """Similar sets share a signature, whatever their sizes."""
    rng = np.random.default_rng(7)
    sets, pairs = [], []
    for n in [*range(5, 60), 80, 107, 133, 190, 400]:
        for _ in range(6):
            base = rng.integers(0, 1 << 63, n + n // 9 + 1, dtype=np.uint64)
            for size in range(n, n + n // 9 + 1):
                for changed in range(n // 19 + 1):
                    other = base[:size].copy()
                    other[:changed] = rng.integers(0, 1 << 63, changed, dtype=np.uint64)
                    if alike(set(base[:n].tolist()), set(other.tolist())):
                        pairs.append((len(sets), len(sets) + 1))
                        sets += [np.sort(base[:n]), np.sort(other)]
    found = defaultdict(set)
    for k, x in zip(*(v.tolist() for v in L.signatures(np.concatenate(sets), np.array([len(s) for s in sets])))):
        found[k].add(x)
    assert len(pairs) > 1000 and all(found[a] & found[b] for a, b in pairs)


def test_lines_without_a_partner_stay_out(spark):
    """Prefix entries of lines that are like no other are not made, though they share rare words."""
    rng = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = ["\n".join(" ".join(rng.choice(vocabulary, rng.integers(12, 40), replace=False)) for _ in range(5)) for _ in range(200)]
    copy = texts[3].split("\n")[2]
    texts += [copy + " more" if len(copy.split()) >= 9 else copy, copy]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    surveyed = L.survey(frame, "text")
    counts = L.token_counts(surveyed)
    words = [w for t in texts for w in t.split()]
    assert counts.sum() == len(words)
    assert counts[int(L.token_hashes([b"v7"])[0]) & (L.CELLS - 1)] >= words.count("v7")
    context = spark.sparkContext
    rows = L.lines(frame, context.broadcast(counts), context.broadcast(L.possible_ids(surveyed)), "doc_id", "text").collect()
    assert len(rows) == 1002
    open_ = {(r.doc_id, r.line) for r in rows if r.digest is not None}
    assert {(3, 2), (200, 0), (201, 0)} <= open_ and len(open_) < 50
    gone = {(r.doc_id, r.line) for r in L.removed(frame).collect() if r.gone}
    assert gone == {(200, 0), (201, 0)}
