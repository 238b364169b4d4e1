import gzip
import hashlib
import os

import pytest

from qcorpus.llm import warc as W
from qcorpus.llm.scratch import folder

SCHEMA = "page_id long, url string, html string, payload string, first_id long"


def pages(spark):
    long = "héllo " * 40
    rows = [(3, "http://a/1", long), (1, "http://a/2", long), (2, None, long), (4, "u\r\nX: y", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100),
            (None, "u", long), (1, "http://a/2", long), (12, "u", "\x1f\x8b\x08 in text " * 30), (13, "u", "z" * 3_000_000),
            (14, "u", "WARC/1.1\r\n\r\n" * 50)]
    rows += [(100 + k, "u", f"page {k} " * (k * 7)) for k in range(60)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    data = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    first = {}
    for p, b in data:
        if p is not None and len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, b in data:
        f = first.get(b, p)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if p == f else "revisit", None if p == f else f))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()),
                  key=str)


@pytest.mark.parametrize("split", [1 << 30, 4000, 101])
def test_round_trip_whatever_the_ranges(spark, split):
    df = pages(spark).where("length(html) < 100000 or html is null" if split < 200 else "true")
    manifest = W.write_warc(W.records(df), folder(spark, "warc"))
    out = W.read_warc(spark, manifest, split_bytes=split)
    assert rows_of(out) == brute(df.collect())
    texts = {r["page_id"]: r["html"] or "" for r in df.collect()}
    for r in out.collect():
        assert r["payload"] == (texts[r["page_id"]] if r["record_type"] == "response" else None)


def test_members_are_plain_gzip_records(spark):
    path = folder(spark, "warc")
    W.write_warc(W.records(pages(spark)), path)
    store, place = W.open_store(path)
    for name in os.listdir(place):
        data = gzip.decompress(open(f"{place}/{name}", "rb").read())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_false_magic_is_passed_over(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 50)
    noise = b"junk" + W.MAGIC + b"more junk" + gzip.compress(b"not a record") + W.MAGIC[:2]
    member = W._member([("WARC-Type", "response"), ("X-Page-Id", "1")], W._HTTP + b"body")
    place = tmp_path / "a.warc.gz"
    place.write_bytes(noise + member + noise + member)
    size = place.stat().st_size
    for step in (size, 7, 1):
        found = [m for at in range(0, size, step) for m in W.members(W._File(str(place)), at, min(at + step, size))]
        assert len(found) == 2 and all(W.parse_record(m)[1] == W._HTTP + b"body" for m in found)


def test_cut_member_raises(tmp_path):
    place = tmp_path / "a.warc.gz"
    place.write_bytes(W._member([("WARC-Type", "response")], os.urandom(9000))[:-2000])
    with pytest.raises(ValueError):
        list(W.members(W._File(str(place)), 0, place.stat().st_size))


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], SCHEMA)).collect() == []
