"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

``write_archives`` makes archives whose whole file is one gzip stream (as some
crawlers leave them). ``normalise`` inflates each stream once, front to back,
rewrites every record as a gzip member of its own, and makes a sidecar index of
(archive, offset, length, record). ``read_records`` reads single members by
their offsets.

Archives are rows of written tables in the shared folder (name, bytes), so any
file system that Spark knows will do and a lost executor's archives are simply
written again. An archive closes at ``ARCHIVE_BYTES`` of records, which bounds
every row but those of single larger pages.

Equal payloads of at least ``REVISIT_BYTES`` become revisits of the one with
the smallest page_id.

Cases: null html is an empty payload; a null url is written empty; a null
page_id comes after all others; rows that repeat both page_id and payload give
one response and revisits that refer to the same page_id; an empty table gives
an empty result; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.llm.common import materialize, new_path, pack, release, slices, unpack_bytes

ARCHIVE_BYTES = 2 << 20
REVISIT_BYTES = 100
#: Gzip level of archives, raw and normalised.
LEVEL = 4
VERSION = b"WARC/1.1"


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC record: version, headers, block and the two empty lines after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return VERSION + b"\r\n" + head.encode() + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_stream(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an inflated stream, holding one record at a time.

    The record's length comes from its Content-Length, so payloads that look like records are safe.
    """
    buf = bytearray()
    at = need = 0
    head: dict[str, str] = {}
    for chunk in chunks:
        buf += chunk
        while True:
            if not need:
                end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = parse_head(bytes(buf[at:end]))
                need = end + 4 - at + int(head["content-length"]) + 4
            if len(buf) - at < need:
                break
            yield head, bytes(buf[at : at + need])
            at, need = at + need, 0
        del buf[:at]
        at = 0
    if bytes(buf).strip():
        raise ValueError("the archive ends within a record")


def inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The stream's bytes, in pieces; several members one after the other are read as well."""
    todo = data
    while todo:
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.decompress(todo, step)
            todo = z.unconsumed_tail if not z.eof else z.unused_data
            if piece:
                yield piece
            elif not z.eof and not todo:
                raise ValueError("the archive's gzip stream is cut off")


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))


def _key() -> Column:
    """The page_id, with a value for none."""
    return F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).cast("long")


def classify(pages: DataFrame) -> DataFrame:
    """(k, digest, first) of every page whose payload another row holds too; first is the smallest page_id."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    meta = pages.select("page_id", _digest().alias("digest"), size.alias("size")).where(F.col("size") >= REVISIT_BYTES)
    pairs = materialize(meta.groupBy("page_id", "digest").agg(F.count("*").alias("n")), "payloads")
    shared = pairs.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("total")).where("total > 1").drop("total")
    return pairs.join(shared, "digest").select(_key().alias("k"), "digest", "first")


def write_archives(pages: DataFrame) -> DataFrame:
    """A written table (archive, content) of gzip streams with a record for each page."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), _digest().alias("digest"))
    rows = rows.mapInArrow(_packed, "page_id long, url string, html binary, digest binary")  # pages travel compressed
    shared = classify(pages).withColumn("shared", F.lit(True))
    rows = rows.withColumn("k", _key()).join(shared.hint("merge"), ["k", "digest"], "left")
    # of rows that repeat both page_id and payload one comes first; they meet in the join already
    turn = F.row_number().over(W.partitionBy("k", "digest").orderBy("url"))
    rows = rows.withColumn("turn", turn).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("first").cast("string"), "shared", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
        for b in batches:
            for page, url, html, digest, first, shared, turn in b.itertuples(index=False):
                payload, digest = unpack_bytes(html), digest.hex()
                revisit = shared is True and not (page == first and turn == 1)
                head = {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}>",
                    "WARC-Target-URI": " ".join(url.split()),
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Payload-Digest": f"sha256:{digest}",
                    "X-Page-Id": page or "",
                    "X-Payload-Length": str(len(payload)),
                }
                if revisit:
                    head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": first or ""}
                raw = record(head, b"" if revisit else payload)
                out.append(z.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield _archive(out, z)
                    z, out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
        if size:
            yield _archive(out, z)

    return materialize(rows.mapInPandas(run, "archive string, content binary"), "archives")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t) for t in b.column(2).to_pylist()], pa.binary()), b.column(3)], names=["page_id", "url", "html", "digest"])


def _archive(out: list[bytes], z) -> pd.DataFrame:
    data = b"".join(out) + z.flush()
    return pd.DataFrame({"archive": [f"{hashlib.sha256(data).hexdigest()[:32]}.warc.gz"], "content": [data]})


INDEX = "archive string, offset long, length long, record_id string, warc_type string, uri string"


def normalise(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the normalised archives (archive, content) and of their sidecar index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in b[["archive", "content"]].itertuples(index=False):
                members, index, at = [], [], 0
                for head, raw in split_stream(inflate(content)):
                    member = gzip.compress(raw, LEVEL, mtime=0)
                    members.append(member)
                    index.append(("index", name, at, len(member), head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), None))
                    at += len(member)
                rows = [*index, ("warc", name, None, None, None, None, None, b"".join(members))]
                yield pd.DataFrame(rows, columns=["kind", "archive", "offset", "length", "record_id", "warc_type", "uri", "content"]).astype({"offset": "Int64", "length": "Int64"})

    spark, path = archives.sparkSession, new_path(archives.sparkSession, "normalised")
    archives.mapInPandas(run, f"kind string, {INDEX}, content binary").write.partitionBy("kind").parquet(path)
    both = spark.read.schema(f"{INDEX}, content binary, kind string").parquet(path)
    return both.where("kind = 'warc'").select("archive", "content"), both.where("kind = 'index'").select(*[c.split()[0] for c in INDEX.split(", ")])


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """The records (type, page, payload facts) that the index lists, each inflated from its own member only."""
    listed = index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for content, places in b[["content", "places"]].itertuples(index=False):
                for place in places:
                    raw = zlib.decompress(content[place["offset"] : place["offset"] + place["length"]], 31)
                    ((head, whole),) = split_stream(iter([raw]))
                    revisit = head["warc-type"] == "revisit"
                    n = int(head["x-payload-length"])
                    payload = whole[len(whole) - 4 - int(head["content-length"]) : len(whole) - 4]
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    rows.append((head["x-page-id"] or None, head["warc-target-uri"], n, digest, head["warc-type"], head.get("x-refers-to-page-id") or None))
            yield pd.DataFrame(rows, columns=["page", "uri", "payload_bytes", "payload_digest", "record_type", "refers"])

    got = archives.join(listed, "archive").mapInPandas(run, "page string, uri string, payload_bytes long, payload_digest string, record_type string, refers string")
    return got.select(F.col("page").cast("long").alias("page_id"), "uri", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("long").alias("refers_to"))


def op7_warc_normalise(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = write_archives(pages)
    archives, index = normalise(raw)
    release(raw)  # both results are written: nothing reads the streams again
    return read_records(archives, index).drop("uri")
