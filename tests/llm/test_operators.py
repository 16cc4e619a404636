"""The corpus operators against brute force on small tables, and their edge cases."""

import collections
import hashlib
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilmark.llm import (
    exact_dedup, graph, host_rules, license_scan, line_dedup, near_dedup, packing, piece_lattice, suffix_index, token_planes, warc_zip,
)
from veilmark.llm.common import shared_folder
from veilmark.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOREM = [f"w{(i * 7919) % 997}" for i in range(600)]
LONG = " ".join(LOREM[:150])
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG + " tail", "b"), (4, None, "a"), (5, "", None), (6, "one two", "b"),
    (7, "é" * 500, "c"), (8, " ".join(LOREM[200:260]) + "\n" + LONG, "c"), (None, LONG, "c"), (9, "x y " * 300, "a"),
    (10, " ".join(LOREM[300:400]), "a"), (10, " ".join(LOREM[300:400]), "a"), (11, "Apache\nLicense, cc-by MIT  license", "b"),
    (12, "ONE two", "b"), (13, "ab" * 30_000 + " z", "d"),
]
EXTRA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, EXTRA).repartition(3)
    # Columns whose names the operators use themselves.
    return frame.select("*", F.lit(1).alias("kept"), F.lit("k").alias("key"), F.lit(2).alias("node"), F.lit(0).alias("h"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


def test_exact_dedup(docs, nothing):
    got = exact_dedup.verdicts(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = sorted(
        (str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]),
         hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.verdicts(nothing).count() == exact_dedup.dedup(nothing).count() == 0
    # A filter that is far too small sends more rows on and changes nothing.
    assert sorted(map(str, exact_dedup.verdicts(docs, max_cells=1).collect())) == sorted(map(str, got))


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {p for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


def test_host_rules(docs, nothing):
    texts = [t for _, t, _ in ROWS] + ["a b c d e f g h " * 3 + "\nx\nx\n \n ", "# $ % <>"]
    got = host_rules.measure_texts(texts)
    assert [list(v) for v in zip(*(got[m] for m in host_rules.MEASURES))] == [base(t) for t in texts]
    rows = host_rules.judge(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(not r.kept for r in rows if r.base_failed)
    clean = host_rules.clean(docs)
    assert clean.columns == docs.columns and clean.count() == sum(r.kept for r in rows)
    assert host_rules.judge(nothing).count() == host_rules.clean(nothing).count() == 0


def test_bad_host_goes_as_a_whole(spark):
    good = " ".join(LOREM[:60])
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(300)]
    rows += [(1000 + i, good, f"host{i % 5}") for i in range(300)] + [(2000, "short", "small"), (2001, good, "small")]
    got = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, EXTRA)).collect()}
    assert not any(got[i].kept for i in range(300))
    assert all(got[1000 + i].kept for i in range(300)) and got[2001].kept
    left = host_rules.clean(spark.createDataFrame(rows, EXTRA))
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("bits", [1, 8])
def test_token_planes(spark, docs, nothing, bits):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    manifest = token_planes.write(
        docs, shared_folder(spark, "t"), tokenizer("byte_bpe_50k.json"), bits=bits, block_ids=1000)
    got = sorted(token_planes.read(manifest).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, text, _ in order:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r)[:4] for r in got] == want
    empty = token_planes.write(nothing, shared_folder(spark, "t"), tokenizer("byte_bpe_50k.json"))
    assert token_planes.read(empty).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, dtype=np.uint32)
    for bits in (1, 8):
        assert (token_planes.join_planes(token_planes.split_planes(ids, bits), len(ids), bits) == ids).all()


def test_encoder_cuts_only_where_it_may():
    from tokenizers import Tokenizer

    from veilmark.llm.tokens import Encoder

    texts = ["a  b\n c\t d ", " lead", "it's 12 345,6 x'll y  \n\nz", "", "é ü　ß  ", "tab\there\x1c there", "A B'S"]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        t = Tokenizer.from_file(tokenizer(name))
        want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert Encoder(tokenizer(name), kind)(texts) == want
        assert Encoder(tokenizer(name), kind, keep=3)(texts * 2) == want * 2


def test_packing(spark, docs, nothing):
    pieces = packing.tokenise(docs, tokenizer("word_bpe_49k.json"), capacity=64)
    got = packing.pack(pieces, 64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert packing.pack(packing.tokenise(nothing, tokenizer("word_bpe_49k.json"))).count() == 0


def test_sweep_places_every_rank_once():
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(rng.permutation(100)[:40] + 1, rng.integers(1, 50, 40))}
    used = collections.Counter()
    seen = collections.defaultdict(set)
    for length, rank, n, sequence, _ in packing.sweep(counts, 100).tolist():
        for k in range(n):
            used[sequence + k] += length
            seen[length].add(rank + k)
    assert max(used.values()) <= 100 and all(seen[k] == set(range(v)) for k, v in counts.items())


def test_warc_round_trip(spark):
    page = "<p>" + "x" * 200
    rows = [(5, "http://a\r\nb", page), (3, "u", page), (None, "u", page), (7, None, None), (8, "u", ""), (9, "u", "short"),
            (10, "u", "short"), (3, "u", page)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    packages = warc_zip.write(pages, shared_folder(spark, "z"))
    got = warc_zip.read(packages).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in got) == sorted(
        ("revisit" if i == 5 else "response", len(h or "")) for i, _, h in rows)
    assert {r.payload_digest for r in got} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
    (again,) = [r for r in got if r.record_type == "revisit"]
    assert (again.record_id, again.refers_to) == ("<urn:page:5>", "<urn:page:3>")
    assert warc_zip.read(warc_zip.write(pages.limit(0), shared_folder(spark, "z"))).count() == 0


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_zip_directories(tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK\x05\x06 not the end"
        with z.open("archive/é.warc", "w", force_zip64=True) as f:
            f.write(b"abc" * 100)
        z.writestr("indexes/i", "line")
    p = warc_zip.Package(Bytes(path.read_bytes()))
    start, n = p.place("archive/é.warc")
    assert p.source.raw[start : start + n] == b"abc" * 100
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", "0123456789abc")
        z.writestr("two", "x" * 50)
    raw = path.read_bytes()
    assert b"PK\x06\x06" in raw
    p = warc_zip.Package(Bytes(raw))
    start, n = p.place("two")
    assert raw[start : start + n] == b"x" * 50
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one", "a" * 500)
    with pytest.raises(ValueError):
        warc_zip.Package(Bytes(path.read_bytes())).place("one")


def test_walk_finds_records_without_index():
    import gzip

    parts = [gzip.compress(bytes([k]) * (k * 1000)) for k in range(1, 6)]
    raw = b"junk" + b"".join(parts)
    got = list(warc_zip.walk(Bytes(raw), 4, len(raw) - 4))
    assert [raw[4 + o : 4 + o + n] for o, n in got] == parts


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(lowered)
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def roots(n, links):
    parent = list(range(n))
    for a, b in links:
        x, y = (next_root(parent, v) for v in (a, b))
        parent[max(x, y)] = min(x, y)
    return [next_root(parent, v) for v in range(n)]


def next_root(parent, v):
    while parent[v] != v:
        v = parent[v]
    return v


def near_rows():
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, (_, t, _) in enumerate(ROWS)]
    seed = LOREM[:120]
    for k in range(60):
        ws = list(seed)
        for _ in range(k % 12):
            ws[rng.integers(len(ws))] = f"n{rng.integers(1000)}"
        rows.append((100 + k, " ".join(ws)))
    return rows


def test_near_dedup(spark, docs, nothing):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {rows[k][0]: rows[r][0] for k, r in enumerate(roots(len(rows), links))}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.groups(frame).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for (i, _), s in zip(rows, sets)}
    left = near_dedup.dedup(frame)
    assert {r.doc_id for r in left.collect()} == set(want.values())
    assert near_dedup.groups(nothing).count() == 0
    assert near_dedup.groups(docs).count() == len(ROWS)


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(8)
    sets = []
    for size in (1, 2, 7, 40, 300, 3000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0, 0.05, 0.14, 0.15, 0.3, 0.9):
            changed = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            sets.append(np.unique(np.where(rng.random(size) < share, changed, base)))
            sets.append(sets[-1][: -(-len(sets[-1]) * 3 // 4)])
    maps = near_dedup.bitmaps(sets)
    dropped = 0
    for one, a in zip(sets, maps):
        for other, reach in zip(sets, near_dedup.within_reach(a, maps)):
            both = len(np.intersect1d(one, other))
            assert reach or 100 * both < 75 * (len(one) + len(other) - both)
            dropped += not reach
    assert dropped > len(sets)


def test_open_pairs_meets_all_blocks(spark):
    rng = np.random.default_rng(2)
    sig = rng.integers(-(1 << 62), 1 << 62, near_dedup.BANDS).tolist()
    sig += near_dedup.bitmaps([np.arange(20, dtype=np.uint64)])[0].tolist()
    classes = spark.createDataFrame([(i, sig) for i in range(40)], "node bigint, sig array<bigint>")
    buckets = spark.createDataFrame([(1, i, 40) for i in range(40)], "bucket bigint, node bigint, n bigint")
    comps = spark.createDataFrame([(i, 0) for i in range(35)], "node bigint, comp bigint")
    got = {tuple(r) for r in near_dedup.open_pairs(buckets, comps, classes, block=7).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if b >= 35}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(60)]
    want = roots(400, links)
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.comp for r in graph.components(frame).collect()}
    ends = {v for a, b in links if a != b for v in (a, b)}
    assert got == {v: want[v] for v in ends}
    both = graph.refine(graph.components(frame.limit(100)), frame)
    assert {r.node: r.comp for r in both.collect() if r.node in ends} == got


@pytest.mark.parametrize("big", [1, 50_000])
def test_suffix_index(spark, docs, nothing, big):
    size = 60
    raws = [(i, (t or "").encode()) for i, t, _ in ROWS]
    seen = collections.Counter(r[s : s + size] for _, r in raws for s in range(len(r) - size + 1))
    want = []
    for i, r in raws:
        cover = bytearray(len(r))
        for s in range(len(r) - size + 1):
            if seen[r[s : s + size]] > 1:
                cover[s : s + size] = b"\1" * size
        kept = bytes(b for b, c in zip(r, cover) if not c)
        runs = len([x for x in bytes(cover).split(b"\0") if x])
        want.append((str(i), len(r), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    got = suffix_index.spans(docs, window=size, gram=16, n_batches=3, big=big).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    clean = suffix_index.clean(docs, window=size, gram=16)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    sizes = {str(i): n - gone for i, n, gone, _, _ in want}
    assert all(r.text is None or len(r.text.encode()) >= sizes[str(r.doc_id)] for r in clean.collect())
    assert suffix_index.spans(nothing).count() == suffix_index.clean(nothing).count() == 0


def test_characters_stay_whole():
    text = "aé" * 5
    for first in range(8):
        left = suffix_index.without_bytes(text, [first], [first], 4)
        assert len(left.encode()) >= len(text.encode()) - 4


def test_license_scan(spark, docs, nothing):
    notice = license_scan.TEMPLATES["mit"]
    wrapped = "\n".join(re.findall(r".{1,60}(?: |$)", notice))
    rows = [
        (1, "x " * 30 + "\n\n" + wrapped + "\n\n" + "y " * 80), (2, "Released under the MIT License."), (3, None), (4, ""),
        (5, "gnu GENERAL public\nlicense / Apache, License and cc-by"), (6, "the of and to in permission " * 40), (None, notice),
    ]
    got = {r.doc_id: r for r in license_scan.labels(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and got[1].score == 1.0
    assert (got[2].base_labels, got[2].labels, got[2].first_word) == ("mit", "mit,mit-short", 3)
    assert got[3].n_words == got[4].n_words == 0 and got[3].labels == "" and got[3].first_word is None
    assert (got[5].base_labels, got[5].n_base, got[5].first_word, got[5].last_word) == ("apache,cc-by,gpl", 3, 0, 7)
    assert got[6].labels == "" and got[6].score == 0 and got[None].labels == "mit"
    assert license_scan.labels(nothing).count() == 0 and license_scan.labels(docs).count() == len(ROWS)


def test_license_join_is_exact(spark):
    rng = np.random.default_rng(8)
    templates = {f"t{k}": " ".join(f"v{v}" for v in rng.choice(30, rng.integers(3, 12), replace=False)) for k in range(12)}
    rows = [(i, " ".join(f"v{v}" for v in rng.integers(0, 40, rng.integers(1, 60)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs_, found = license_scan.scan(frame, templates, 0.7, whole=0)
    ids = {r.row: r.doc_id for r in docs_.select("row", "doc_id").collect()}
    got = collections.Counter((ids[r.row], r.template) for r in found.collect())
    want = collections.Counter()
    for i, t in rows:
        ws = t.split()
        for k, v in templates.items():
            v, width = set(v.split()), 8 if len(v.split()) <= 8 else 16
            cells = [set(ws[a : a + width]) for a in range(0, len(ws), width)]
            # Windows that only repeat the cell before them are not reported on their own.
            known = {w for x in templates.values() for w in x.split()}
            for c, cell in enumerate(cells):
                behind = cells[c + 1] & known if c + 1 < len(cells) else set()
                if cell & known and (behind or not c or not cells[c - 1] & known):
                    want[i, k] += len((cell | behind) & v) >= 0.7 * len(v) - 1e-9
    assert got == +want and len(got) > 50


def test_license_windows(spark):
    far = " ".join(f"{w} " + "x " * 150 for w in "Released under these terms for license and mit staff".split())
    notice = license_scan.TEMPLATES["bsd-3-clause"]
    wide = notice.replace(" ", "\n" + "=" * 120 + "\n", 1) + " " + "z" * 500
    rows = [
        (1, far), (2, "Released under the old license by us."), (3, "a " * 13 + notice), (4, wide), (5, "\n\n".join(notice.split())),
        (6, "b " * 100_003 + notice + " c" * 100_000), (7, (notice + "\n") * 50), (8, "b " * 100 + " ".join(notice.split()[:10])),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.labels(frame).collect()}
    none, found = ("", 0.0), ("bsd-3-clause", 1.0)
    assert got == {1: none, 2: none, 3: found, 4: found, 5: found, 6: found, 7: found, 8: none}


def test_line_dedup(spark, nothing):
    rng = np.random.default_rng(9)
    rows = [(None, " ".join(LOREM[:30])), (50, None), (51, ""), (52, "a b c d\na b c d")]
    for k in range(40):
        ls = []
        for _ in range(3):
            ws = list(LOREM[: 30 + 30 * int(rng.integers(3))])
            for _ in range(int(rng.integers(5))):
                ws[rng.integers(len(ws))] = f"n{rng.integers(60)}"
            ls.append(" ".join(rng.permutation(ws)))
        rows.append((k, "\n".join(ls)))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = [], {}
    for i, t in order:
        n = gone = 0
        for line in (t or "").split("\n"):
            s = set(line.split())
            if len(s) >= line_dedup.MIN_TOKENS:
                n += 1
                gone += any(10 * len(s & o) >= 9 * len(s | o) for o in seen)
                seen.append(s)
        want[i] = (n, gone)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.summary(frame).collect()}
    assert got == want and sum(g for _, g in want.values()) > 10
    assert line_dedup.summary(nothing).count() == 0


def test_piece_lattice(spark, docs, nothing):
    from pyspark.sql import functions as F

    table = piece_lattice.pieces(spark, tokenizer("piece_bpe_32k.model"))
    texts = ["the cat's é\n\tünïcode 日本 \U0001f600", " two  spaces ", "", None, "a" * 300 + " end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("pos", F.lit(1))
    got = {r.id: r for r in piece_lattice.decode(piece_lattice.encode(frame, table), table).collect()}
    assert [got[i].decoded for i in range(len(texts))] == [t or "" for t in texts]

    scores = {r.piece: r.score for r in table.filter("NOT is_byte").collect()}
    worst, by_id = min(scores.values()) + piece_lattice.UNKNOWN, {r.id: r for r in table.collect()}
    for word in ("▁the", "▁ünïcode", "▁tokenization", "▁日本"):
        best = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            ways = [best[a] + scores.get(word[a:end], worst if end - a == 1 else float("-inf")) for a in range(end)]
            best[end] = max(ways)
        (row,) = piece_lattice.lattice(spark.createDataFrame([(word,)], "word string"), table).collect()
        plain = [i for i in row.ids if not by_id[i].is_byte]
        unknown = len(word) - sum(len(by_id[i].piece) for i in plain)
        assert abs(sum(by_id[i].score for i in plain) + unknown * worst - best[-1]) < 1e-6
    counts = {r.id: (r.n_words, r.n_tokens) for r in piece_lattice.digests(frame, table, ["id"]).collect()}
    assert counts[2] == counts[3] == (0, 0) and counts[0][1] == len(got[0].ids)
    assert piece_lattice.digests(nothing, table, ["doc_id"]).count() == 0


def test_piece_lattice_keeps_rows_together(spark):
    from pyspark.sql import functions as F

    table = piece_lattice.pieces(spark, tokenizer("piece_bpe_32k.model"))
    texts = [f"row {k} {'of many words ' * (k % 4)}" for k in range(200)] * 2
    # Behind a shuffle, and with columns named like the operator's own.
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row int, _d string").repartition(7, "_d")
    got = piece_lattice.decode(piece_lattice.encode(frame, table, "_d"), table).collect()
    assert sorted((r._row, r.decoded) for r in got) == list(enumerate(texts))
    per = piece_lattice.digests(frame, table, ["_row"], "_d").collect()
    assert sorted((r._row, r.n_words) for r in per) == [(i, len(t.split(" "))) for i, t in enumerate(texts)]
    ids = {r._row: r.ids for r in piece_lattice.encode(frame, table, "_d").collect()}
    assert all(r.n_tokens == len(ids[r._row]) for r in per)
    same = {}
    for r in per:
        assert same.setdefault(texts[r._row], r.ids_hash) == r.ids_hash


def test_piece_lattice_fits_log_probabilities(spark):
    """Expected counts against all ways to cut each word, and the query's scores add up to probabilities."""
    import math

    rows = [("▁", 0, -0.0), ("a", 1, -1.0), ("b", 2, -2.0), ("ab", 3, -3.0), ("▁a", 4, -4.0), ("ba", 5, -5.0), ("zz", 6, -1e9)]
    kind = "piece string, id int, score double, is_byte boolean"
    table = spark.createDataFrame([(*r, False) for r in rows] + [("<0x41>", 7, 0.0, True)], kind)
    counts = {"▁abab": 5, "▁a": 3, "▁bab": 2, "▁xab": 1}

    def ways(word, pieces):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in pieces or k == 1:
                for rest in ways(word[k:], pieces):
                    yield [word[:k], *rest]

    weigh = {p: 1 / (min(max(-s, 0), len(rows)) + 1) for p, _, s in rows}
    score = {p: math.log(w / sum(weigh.values())) for p, w in weigh.items()}
    for _ in range(piece_lattice.ROUNDS):
        unknown, sums = min(score.values()) + piece_lattice.UNKNOWN, dict.fromkeys(score, 0.0)
        for word, n in counts.items():
            weights = [(w, math.exp(sum(score.get(p, unknown) for p in w))) for w in ways(word, score)]
            for w, x in weights:
                for p in w:
                    if p in sums:
                        sums[p] += n * x / sum(y for _, y in weights)
        sums = {p: max(v, piece_lattice.LEAST_COUNT) for p, v in sums.items()}
        score = {p: math.log(v / sum(sums.values())) for p, v in sums.items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    fitted = piece_lattice.fit(words, table)
    got = {r.piece: r.score for r in fitted.collect() if not r.is_byte}
    assert got.keys() == score.keys() and all(abs(got[p] - score[p]) < 1e-5 for p in score)
    assert fitted.filter("is_byte").count() == 1
    turns = spark.createDataFrame([(i, 0, w.replace("▁", "")) for i, (w, n) in enumerate(counts.items()) for _ in range(n)], "conv_id int, turn int, text string")
    # Frequent pieces win, where merge ranks prefer whatever came first among the merges.
    ids = {r.text: r.ids for r in piece_lattice.encode(turns, table, fitted=True).distinct().collect()}
    for word in ("▁abab", "▁bab", "▁a"):
        best = max(ways(word, score), key=lambda w: sum(score.get(p, -1e3) for p in w))
        by_piece = {p: i for p, i, _ in rows}
        assert ids[word[1:]] == [by_piece[p] for p in best]


def test_piece_lattice_query_takes_all_texts_whole(spark, tmp_path, monkeypatch):
    """Documents and turns, each text as one lattice from end to end: fitted scores, best paths, ids and their text."""
    import math

    from veilmark.llm.queries import QUERIES

    long = "tokenization" * 25 + "é" * 140 + "\U00012000" * 3
    docs = [(1, f"a {long} of it"), (1, "the same row"), (1, "the same row"), (2, None), (3, ""), (None, "  two  spaces\tand\n\nlines "),
            (4, "word after word " * 40 + "rare \u65e5\u672c"), (5, f"x{long[1:]}"), (6, " ")]
    turns = [(1, 0, "user", "the end of it"), (1, 1, "user", None), (1, 2, "user", long[3:])]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    # Units that are broadcast and units that are joined, in texts of several buckets.
    monkeypatch.setattr(piece_lattice, "HOT_UNITS", 9)
    monkeypatch.setattr(piece_lattice, "BUCKET_UNITS", 50)
    got = QUERIES["op9_piece_lattice"](spark, str(tmp_path)).collect()

    table = piece_lattice.pieces(spark, tokenizer("piece_bpe_32k.model")).collect()
    ranks, id_of = {r.piece: r.score for r in table if not r.is_byte}, {r.piece: r.id for r in table}
    texts = [t for *_, t in docs] + [t for *_, t in turns]
    lattices = ["\u2581" + t.replace(" ", "\u2581") for t in texts if t]

    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)

    weigh = {p: 1 / (min(max(-s, 0), len(ranks)) + 1) for p, s in ranks.items()}
    score = {p: math.log(w / sum(weigh.values())) for p, w in weigh.items()}
    for _ in range(piece_lattice.ROUNDS):
        least, sums = min(score.values()), dict.fromkeys(score, 0.0)
        for text in lattices:
            own = [[(a, p, score.get(p, least + piece_lattice.UNKNOWN)) for a in range(max(0, end - 16), end) for p in [text[a:end]]
                    if p in score or end - a == 1] for end in range(1, len(text) + 1)]
            ahead, back = [0.0] + [-math.inf] * len(text), [-math.inf] * len(text) + [0.0]
            for end, found in enumerate(own, 1):
                for a, _, s in found:
                    ahead[end] = add(ahead[end], ahead[a] + s)
            for end in range(len(text), 0, -1):
                for a, p, s in own[end - 1]:
                    back[a] = add(back[a], back[end] + s)
            for end, found in enumerate(own, 1):
                for a, p, s in found:
                    if p in sums:
                        sums[p] += math.exp(ahead[a] + s + back[end] - ahead[-1])
        sums = {p: max(v, piece_lattice.LEAST_COUNT) for p, v in sums.items()}
        total = sum(sums.values())
        score = {p: math.log(v / total) for p, v in sums.items()}
    unknown = min(score.values()) + piece_lattice.UNKNOWN

    def best(text):
        to = [0.0]
        for end in range(1, len(text) + 1):
            to.append(max(to[a] + score.get(text[a:end], unknown) for a in range(max(0, end - 16), end) if text[a:end] in score or end - a == 1))
        return to[-1]

    by_id = {r.id: r for r in table}
    want = sorted([(i, None, None, t) for i, t in docs] + [(None, c, k, t) for c, k, _, t in turns], key=str)
    have = []
    for r in got:
        # Byte pieces stand for characters without a piece.
        body = b"".join(bytes.fromhex(by_id[i].piece[3:5]) if by_id[i].is_byte else by_id[i].piece.replace("\u2581", " ").encode() for i in r.ids)
        text = body.decode()[1:]
        assert r.restored and r.n_tokens == len(r.ids) and r.n_words == (len(text.split(" ")) if text else 0)
        if text:
            marked = "\u2581" + text.replace(" ", "\u2581")
            plain = [by_id[i].piece for i in r.ids if not by_id[i].is_byte]
            path = sum(score[p] for p in plain) + unknown * (len(marked) - sum(map(len, plain)))
            assert abs(path - best(marked)) < 1e-3
        have.append((r.doc_id, r.conv_id, r.turn, text))
    assert sorted(((a, b, c, t or "") for a, b, c, t in want), key=str) == sorted(have, key=str)
    assert len({r.ids_hash for r in got if not r.ids}) == 1
    assert id_of["<0xF0>"] in {i for r in got for i in r.ids}


def test_piece_lattice_of_long_units(spark):
    """A unit of many blocks and characters has the path of a plain fold."""
    table = piece_lattice.pieces(spark, tokenizer("piece_bpe_32k.model"))
    scores = {r.piece: r.score for r in table.filter("NOT is_byte").collect()}
    by_id = {r.id: r.piece for r in table.collect()}
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdenst"), n)) for n in (1, 127, 128, 129, 255, 256, 257, 3000)]
    got = {r.word: r.ids for r in piece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    for word in words:
        to = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            # Of equal scores the edge that starts first.
            to.append(max((to[a][0] + scores[word[a:end]], end - a) for a in range(max(0, end - 16), end) if word[a:end] in scores))
        path, at = [], len(word)
        while at:
            path.append(word[at - to[at][1] : at])
            at -= to[at][1]
        assert [by_id[i] for i in got[word]] == path[::-1]


def test_open_pairs_gives_no_more_links_than_members(spark):
    """Checked where they meet, a bucket of n similar texts gives a tree of links, not all pairs."""
    rows = [(i, " ".join([*LOREM[:80], f"x{i}"])) for i in range(30)]
    rows += [(30 + i, " ".join([*LOREM[:80], *LOREM[300 : 322 + i % 3], f"y{i}"])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = near_dedup.cut(near_dedup.classes_of(near_dedup.profiles(docs, "doc_id", "text")).withColumn("node", F.col("rep")))
    # One bucket, no links yet.
    buckets = classes.select(F.lit(1).cast("bigint").alias("bucket"), "node", F.lit(len(rows)).alias("n"))
    comps = spark.createDataFrame([], "node bigint, comp bigint")

    def texts(nodes):
        return near_dedup.texts_of(docs, classes.select("node", "rep", "h").join(nodes, "node"), "doc_id", "text")

    found = [tuple(r) for r in near_dedup.open_pairs(buckets, comps, classes, texts=texts).collect()]
    sets = [shingles(t) for _, t in rows]
    links = {(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert set(found) <= links and len(found) < len(rows) < len(links)
    assert roots(len(rows), found) == roots(len(rows), links)
    parted = near_dedup.open_pairs(buckets, comps, classes, block=9, texts=texts).collect()
    assert {tuple(r) for r in parted} <= links and roots(len(rows), [tuple(r) for r in parted]) == roots(len(rows), links)
