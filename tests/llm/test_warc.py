import gzip
import hashlib
import io

import pytest

from leafmill.llm import common, warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    """Sorted (page_id, bytes, digest, type, refers_to) from (page_id, html)."""
    smallest = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            smallest[data] = min(i, smallest.get(data, i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        first = smallest.get(data)
        revisit = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def test_query_equals_plain_rule(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert got(warc.query(spark, SF)) == expected([(r.page_id, r.html) for r in pages])


def test_round_trip_with_edges(spark):
    page = "<p>Größe \r\n\r\n \U0001f600</p>" * 9
    rows = [(7, "http://a.b/\nc d", page), (3, None, page), (3, None, page), (None, "x", page), (4, "é", None), (5, "u", ""), (6, "u", ""), (8, "u", "z" * 3_000_000), (None, "v", "y" * 200), (-2, "w", "k" * 99), (9, "w", "k" * 99)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, digest string")
    files = warc.write_archives(pages, common.scratch_path(spark, "w"), archive_bytes=600)
    assert files.count() > 2
    back = warc.read_archives(spark, files)
    assert got(back) == expected([(r[0], r[2]) for r in rows])
    payloads = {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert payloads[3] == page and payloads[8] == "z" * 3_000_000 and payloads[4] == ""


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(pages, common.scratch_path(spark, "w"))
    assert warc.read_archives(spark, files).count() == 0


def test_each_record_is_a_gzip_member_and_damage_is_found():
    whole = [warc.record_bytes(1, "u", b"abc" * 50, None), warc.record_bytes(2, "u", b"abc" * 50, 1)]
    data = b"".join(map(warc.member, whole))
    assert gzip.decompress(data) == b"".join(whole)
    assert [m for _, m in warc.members(io.BytesIO(data))] == whole
    found = list(warc.records(io.BytesIO(data)))
    assert [r["warc-type"] for r in found] == ["response", "revisit"] and found[1]["payload"] == b"" and found[1]["payload_bytes"] == 150
    assert found[1]["offset"] == len(warc.member(whole[0]))
    for bad in (whole[0].replace(b"abcabc", b"abcabd", 1), whole[0].replace(b"Content-Length: 150\r\n\r\n", b"Content-Length: 150\r\n\r\nx"), whole[0][:-5], b"no header"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(warc.member(bad))))
    with pytest.raises(ValueError, match="ends early"):
        list(warc.records(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records(io.BytesIO(data[:20] + b"\xff\xff\xff" + data[23:])))
