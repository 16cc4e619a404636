"""Packages that other programs wrote, and damaged ones."""

import base64
import gzip
import hashlib
import json
import zipfile

import pytest

from veilmark.llm import warc_zip
from veilmark.llm.warc_zip import make_record


def record(k, payload=b"<p>page"):
    return make_record(k, f"http://x/{k}", payload, hashlib.sha256(payload).hexdigest(), None)


def package(path, archives, indexes=(), packed=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", packed) as z:
        for name, raw in archives:
            z.writestr(f"archive/{name}", raw)
        for name, raw in indexes:
            z.writestr(f"indexes/{name}", raw, zipfile.ZIP_DEFLATED)
    return str(path)


def read(spark, *paths, **options):
    rows = warc_zip.read(spark.createDataFrame([(p,) for p in paths], "path string"), **options).collect()
    good = sorted(r.record_id for r in rows if r.error is None)
    return good, sorted((r.path, r.error) for r in rows if r.error is not None)


def urns(*ids):
    return sorted(f"<urn:page:{k}>" for k in ids)


def lines(parts, name, text=False):
    at, out = 0, []
    for part in parts:
        place = {"offset": at, "length": len(part)}
        out.append("com,x)/ 2020 " + json.dumps({"filename": name, **{k: str(v) if text else v for k, v in place.items()}}))
        at += len(part)
    return "\n".join(['!meta 0 {"format": "cdxj"}', *out, ""]).encode()


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("zipped", [False, True])
def test_usual_indexes(spark, tmp_path, text, zipped):
    parts = [gzip.compress(record(k)) for k in range(3)]
    index = lines(parts, "data.warc.gz", text)
    more = [("index.cdx.gz", gzip.compress(index)), ("index.idx", b"leads to the other")] if zipped else [("index.cdxj", index)]
    path = package(tmp_path / "a.wacz", [("data.warc.gz", b"".join(parts))], more)
    assert read(spark, path) == (urns(0, 1, 2), [])


def test_archives_without_index_lines(spark, tmp_path):
    plain = b"".join(record(k, b"x" * 9000 * k) for k in (3, 4, 5))
    parts = [gzip.compress(record(k)) for k in range(2)]
    path = package(
        tmp_path / "a.wacz", [("one.warc.gz", b"".join(parts)), ("two.warc", plain)], [("i.cdxj", lines(parts, "one.warc.gz"))]
    )
    assert read(spark, path) == (urns(0, 1, 3, 4, 5), [])


def test_damage_ends_no_job(spark, tmp_path):
    parts = [gzip.compress(record(k)) for k in range(4)]
    broken = parts[:1] + [b"\x1f\x8b" + b"\0" * (len(parts[1]) - 2)] + parts[2:]
    index = lines(parts, "data.warc.gz") + b'no {"filename": "other.warc.gz", "offset": 0, "length": 1}\n{"offset": 1}\n{broken\n'
    index += b'{"filename": "data.warc.gz", "offset": 0, "length": 99999999}\n'
    a = package(tmp_path / "a.wacz", [("data.warc.gz", b"".join(broken))], [("i.cdxj", index)])
    b = package(tmp_path / "b.wacz", [("data.warc.gz", b"".join(parts))], packed=zipfile.ZIP_DEFLATED)
    c = tmp_path / "c.wacz"
    c.write_bytes(b"no package")
    d = package(tmp_path / "d.wacz", [("data.warc.gz", b"".join(parts[:2]) + parts[2][:20]), ("e.warc", record(9) + b"junk")])
    e = package(tmp_path / "e.wacz", [])
    f = str(tmp_path / "missing.wacz")
    good, bad = read(spark, a, b, str(c), d, e, f)
    assert good == sorted(urns(0, 2, 3) + urns(0, 1, 9))
    assert [p for p, _ in bad] == sorted([a] * 5 + [b, str(c), d, d, f])


def test_digests_of_other_kinds(spark, tmp_path):
    body = b"<p>page"
    own = record(0, body)
    mark = b"sha256:" + hashlib.sha256(body).hexdigest().encode()
    named = [
        b"sha1:" + base64.b32encode(hashlib.sha1(body).digest()), b"md5:" + hashlib.md5(body).hexdigest().upper().encode(),
        b"blake3:unknown", b"sha1:" + base64.b32encode(hashlib.sha1(b"other").digest()),
    ]
    raw = b"".join(gzip.compress(own.replace(mark, n).replace(b"urn:page:0", b"urn:page:%d" % k)) for k, n in enumerate(named))
    good, bad = read(spark, package(tmp_path / "a.wacz", [("data.warc.gz", raw)]), with_payload=False)
    assert good == urns(0, 1, 2) and [e for _, e in bad] == ["the payload does not match its digest"]
