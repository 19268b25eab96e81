import gzip
import hashlib

import pytest

from threshline.llm import warc

PAGES = [
    (5, "http://a", "x" * 200), (3, "http://b\r\n", "x" * 200), (9, None, "x" * 200), (9, None, "x" * 200), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (7, "u", ""),
    (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20), (None, "n", "y" * 150), (10, "é", "é" * 60), (11, "v", "z" * 5_000_000), (12, "v", "z" * 5_000_000), (20, "w", "w" * 300), (20, "w", "w" * 300),
]


def brute(pages):
    rows, seen = [], set()
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        b = (html or "").encode()
        first = min((p for p, _, h in pages if (h or "").encode() == b and p is not None), default=None)
        again = len(b) >= 100 and ((page != first) or b in seen) and sum((h or "").encode() == b for _, _, h in pages) > 1
        seen.add(b)
        rows.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(rows, key=str)


def test_round_trip_against_brute_force(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    archives, index = warc.normalise(warc.write_archives(pages))
    got = warc.read_records(archives, index).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(PAGES)
    files = {r.archive: r.content for r in archives.collect()}
    for r in index.collect():
        member = files[r.archive][r.offset : r.offset + r.length]
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and r.record_id.encode() in gzip.decompress(member)
    for name, content in files.items():
        assert sum(r.length for r in index.where(f"archive = '{name}'").collect()) == len(content)


def test_streams_of_one_or_many_members_and_cut_streams():
    recs = [warc.record({"WARC-Type": "response", "N": str(i)}, b"p" * i * 1000) for i in range(50)]
    one, many = gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))
    for data in (one, many):
        assert [raw for _, raw in warc.split_stream(warc.inflate(data, 777))] == recs
    with pytest.raises(ValueError):
        list(warc.split_stream(warc.inflate(one[:-40])))
    assert list(warc.split_stream(iter([]))) == []


def test_empty(spark):
    archives, index = warc.normalise(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")))
    assert warc.read_records(archives, index).count() == 0
