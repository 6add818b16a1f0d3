"""WARC bundles: round trips, the seekable format, and who is the response."""

import base64
import hashlib
import io
import struct
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from doorflux.llm import warc
from doorflux.llm.queries import QUERIES

SCHEMA = "page_id bigint, url string, html string, page string, same int, number int, bytes int"
LONG = "é<p>" * 500_000
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (7, "http://a/7", "<p>one</p>"),
    (3, None, "<p>two</p>"), (3, "http://a/3", "<p>two</p>"), (3, "http://a/3", "<p>two</p>"), (3, "http://a/3", "<p>two</p>"),
    (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a b/\r\nX-Page: 9\t☃", LONG),
    (None, "http://a/n", "<p>none</p>"), (None, "http://a/n", "<p>none</p>"), (8, "http://a/8", "\r\n\r\nWARC/1.1\r\n\r\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def wanted(rows, least=0):
    out = Counter()
    for html, group in groups(rows).items():
        payload = html.encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = max(group, key=lambda i: -1 if i is None else i)
        at = group.index(first)
        for k, i in enumerate(group):
            kind = "response" if k == at or len(payload) < least else "revisit"
            out[i, len(payload), digest, kind, first if kind == "revisit" else None] += 1
    return out


def groups(rows):
    held = {}
    for i, _, html in rows:
        held.setdefault(html or "", []).append(i)
    return held


def summary(found):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)


@pytest.mark.parametrize("least", [0, 11])
def test_archives_hold_every_page(spark, tmp_path, least):
    index = warc.write(warc.records(frame(spark, ROWS).repartition(3), least=least), str(tmp_path), frame_bytes=300)
    found = warc.read(index).collect()
    assert summary(found) == wanted(ROWS, least)
    held = Counter((r.page_id, r.payload.decode()) for r in found if r.payload is not None)
    assert sum(held.values()) == sum(r.record_type == "response" for r in found)
    assert {html or "" for _, _, html in ROWS} == {text for _, text in held}
    ids = [r.record_id for r in found]
    assert len(set(ids)) == len(ids) == index.count()
    responses = {r.record_id: r for r in found if r.record_type == "response"}
    for r in found:
        if r.record_type == "revisit":
            assert responses[r.refers_to_record].payload_digest == r.payload_digest
            assert responses[r.refers_to_record].page_id == r.refers_to
    assert all("\r" not in (r.url or "") and "\n" not in (r.url or "") for r in found)
    # a record alone, by its identifier
    one = next(r for r in found if r.page_id == 8)
    assert warc.read(index.where(index.record_id == one.record_id)).first().payload == b"\r\n\r\nWARC/1.1\r\n\r\n"


def test_any_reader_unpacks_a_bundle(spark, tmp_path):
    index = warc.write(warc.records(frame(spark, ROWS)).coalesce(1), str(tmp_path), frame_bytes=300).collect()
    (path,) = tmp_path.glob("*.warc.zst")
    packed = path.read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(packed), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    count, flags, magic = struct.unpack("<IBI", packed[-9:])
    assert (flags, magic) == (0, 0x8F92EAB1) and count == len({r.frame for r in index})
    table = [struct.unpack_from("<II", packed, len(packed) - 9 - 8 * (count - k)) for k in range(count)]
    assert struct.unpack_from("<II", packed, sum(t[0] for t in table)) == (0x184D2A5E, 8 * count + 9)
    assert sum(t[1] for t in table) == len(whole)
    # a frame is one record or no more than asked for, and offsets are within it
    starts = [sum(t[1] for t in table[:k]) for k in range(count)]
    for r in index:
        record = whole[starts[r.frame] + r.offset:][:r.length]
        assert record.startswith(b"WARC/1.1") and warc.parsed(record)["WARC-Record-ID"] == r.record_id
        assert r.offset + r.length <= max(300, r.length)


def test_bundles_are_cut_and_damage_is_seen(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"<p>{hashlib.sha256(str(k).encode()).hexdigest() * 40}</p>") for k in range(60)]
    index = warc.write(warc.records(frame(spark, rows)).coalesce(1), str(tmp_path), frame_bytes=3000, bundle_bytes=1000)
    assert index.select("bundle").distinct().count() > 3
    assert summary(warc.read(index).collect()) == wanted(rows)
    record = warc.made("=1", "u", 0, warc.digest32(b"abc"), 3, b"abc")[1]
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="no seek table"):
        warc.BundleReader(io.BytesIO(b"x" * 50), 50)


def test_copies_are_numbered_in_steps(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [(1, "u", "same")] * 50 + [(2, "u", "same")]
    assert summary(warc.read(warc.archive(frame(spark, rows))).collect()) == wanted(rows)


def test_bundles_are_not_as_many_as_partitions(spark, monkeypatch):
    rows = [(k, f"http://a/{k}", f"<p>{k % 200}</p>") for k in range(300)]
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        index = warc.archive(frame(spark, rows))
        most = 2 * 2 * spark.sparkContext.defaultParallelism  # responses and revisits, two a core
        assert most < 90 and index.select("bundle").distinct().count() <= most
        assert index.rdd.getNumPartitions() <= most
        assert summary(warc.read(index).collect()) == wanted(rows)
        monkeypatch.setattr(warc, "TASK_BYTES", 50)
        assert warc.writers(frame(spark, rows)) == -(-sum(len(html) for _, _, html in rows) // 50)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_query(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert summary(QUERIES["op13_warc_bundles"](spark, sf_dir).collect()) == wanted(pages)
    assert warc.read(warc.archive(frame(spark, []))).collect() == []
    assert isinstance(warc.read(warc.archive(frame(spark, ROWS))).toArrow(), pa.Table)
