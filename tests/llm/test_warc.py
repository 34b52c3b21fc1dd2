"""WARC archives: exact round trips, independent reading, and damage."""

import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from soundrows.llm import warc

PAGES = [
    (1, "http://a/1", "<p>é same</p>"), (2, "http://a/2", "<p>é same</p>"), (9, "http://a/9", "<p>é same</p>"),
    (3, "http://a/\r\nX: y", None), (4, None, ""), (5, "u", "x" * 300_000), (6, "u", "other"), (6, "u", "other"),
    (7, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "lone"), (None, "n", "twice"), (8, "n", "twice"),
    (None, None, "nulls"), (None, None, "nulls"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        last = max(same, key=lambda p: -1 if p is None else p)
        revisit = len(body) >= least and page != last
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "revisit" if revisit else "response", last if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = warc.round_trip(frame(spark).withColumn("payload", F.lit("clash")), least).collect()
    assert Counter(map(tuple, rows)) == expected(PAGES, least)


def test_large_duplicate_tables_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "fits_broadcast", lambda *a: False)
    assert Counter(map(tuple, warc.round_trip(frame(spark)).collect())) == expected(PAGES)


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_archives_payloads_and_rollover(spark, tmp_path):
    manifest = warc.write(frame(spark), f"file://{tmp_path}", archive_bytes=200)
    names = [r.archive for r in manifest.collect()]
    assert len(names) > 3 and sum(r.n_records for r in manifest.collect()) == len(PAGES)
    records = warc.read(manifest, with_payload=True).filter("record_type != 'warcinfo'").collect()
    assert {r.problem for r in records} == {None}
    got = Counter((r.record_id, r.payload.decode()) for r in records if r.record_type == "response")
    assert got[f"{warc.ID}5", "x" * 300_000] == 1 and got[f"{warc.ID}6", "other"] == 2
    uris = {r.target_uri for r in records}
    assert "http://a/%0D%0AX: y" in uris and None in uris
    # The standard library reads the same members.
    text = gzip.open(names[0].removeprefix("file://")).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def archive(*payloads):
    return b"".join(warc.page_record(str(i), "u", p, None, warc.UNKNOWN_DATE) for i, p in enumerate(payloads))


def read(raw):
    return list(warc.read_archive(io.BytesIO(raw), True))


def test_framing_in_small_chunks(monkeypatch):
    payloads = [b"", b"a", b"\r\n\r\n" * 50, bytes(range(256)) * 40]
    for chunk in (1, 7, 64):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [r["payload"] for r in read(archive(*payloads))] == payloads


def test_damage_is_told():
    sound = archive(b"first", b"second")
    assert [r.get("problem") for r in read(sound[:-9])] == [None, "truncated member"]
    assert read(sound + b"no member")[-1]["problem"].startswith("bad member")
    plain = gzip.decompress(archive(b"payload"))
    changed = read(gzip.compress(plain.replace(b"payload\r\n", b"PAYLOAD\r\n")))
    assert changed[0]["problem"] == "block digest differs"
    longer = read(gzip.compress(plain + b"rest"))
    assert longer[0]["problem"] == "block longer than its Content-Length"
    shorter = read(gzip.compress(plain[:-8]))
    assert shorter[0]["problem"] == "block shorter than its Content-Length"
    assert read(gzip.compress(b"not a record\r\n\r\n"))[0]["problem"] == "not a WARC record"


def test_urls_of_any_length(spark):
    pages = [(1, "http://a/" + "x" * 1_200_000, "body"), (2, "http://a/" + "y" * 3_000_000, "body")]
    assert Counter(map(tuple, warc.round_trip(frame(spark, pages)).collect())) == expected(pages)
