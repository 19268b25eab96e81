"""Mail sources: folders, single files and mbox files as (path, raw), and their parsing.

Parsing needs the standard library's mail package and runs as one Arrow-batched
function over batches; what follows it is native.
"""

from __future__ import annotations

import email
import re
from collections.abc import Iterator
from email import policy
from email.message import Message

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threshline.functions.headers import decode_words
from threshline.functions.text import mail_id
from threshline.sources import html

PARSED = "body string, headers array<struct<name:string,value:string>>, visible_urls array<string>, hidden_urls array<string>, text_urls array<string>, from_unproven boolean"
#: Bytes read as text of a mail that no parser takes.
MOST = 1_000_000
_WORD, _WORDS = pa.string(), pa.list_(pa.string())


def read_mail(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """(mail_id, path, raw) of one file, or of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(mail_id(F.col("content")).alias("mail_id"), "path", F.col("content").alias("raw"))


def split_mbox(raw: bytes) -> list[bytes]:
    """Messages of an mbox: each starts at a "From " line after an empty one; ">From " is unquoted."""
    parts = re.split(rb"(?:\A|(?<=\n)\r?\n|(?<=\n\n))From [^\n]*\n", raw)
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p) for p in parts if p.strip()]


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(mail_id, path, pos, raw) of every message of mbox files, through Spark's file systems."""

    @F.udtf(returnType="pos int, raw binary")
    class Messages:
        def eval(self, content: bytes):
            yield from enumerate(split_mbox(bytes(content or b"")))

    spark.udtf.register("threshline_mbox", Messages)
    spark.read.format("binaryFile").load(path).createOrReplaceTempView("threshline_mbox_files")
    d = spark.sql("SELECT f.path, m.pos, m.raw FROM threshline_mbox_files f, LATERAL threshline_mbox(f.content) m")
    return d.select(mail_id(F.col("raw")).alias("mail_id"), "path", "pos", "raw")


class MboxSource(DataSource):
    """``spark.read.format("mbox").load(path)`` for files on a path that workers share."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "path string, pos int, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _MboxReader(self.options["path"])


class _MboxReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for i, raw in enumerate(split_mbox(f.read())):
                yield partition.value, i, raw


def _text(part: Message) -> str:
    data = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", "utf-8", "latin-1"):
        try:
            return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def parse(raw: bytes) -> dict:
    """Body, headers as written and link groups of one mail, read whole; never fails."""
    try:
        m = email.message_from_bytes(raw, policy=policy.compat32)
        parts = [p for p in m.walk() if not p.is_multipart()]
        pages = [_text(p) for p in parts if p.get_content_type() == "text/html"]
        plain = [_text(p) for p in parts if p.get_content_type() == "text/plain"]
        headers = [{"name": str(k), "value": decode_words(str(v))} for k, v in m.items()]
    except Exception:  # a mail that no parser takes is still text to judge
        pages, plain, headers = [], [raw[:MOST].decode("utf-8", "replace")], []
    seen, hidden = [], []
    told = [html.told(page) for page in pages]
    for _, v, h, _ in told:
        seen += v
        hidden += h
    body = told[0][0] if pages else "\n".join(plain)
    return {"body": body, "headers": headers, "visible_urls": seen, "hidden_urls": hidden, "text_urls": html.URL.findall("\n".join(plain) or body), "from_unproven": sum(h["name"].lower() == "from" for h in headers) > 1}


def parse_mail(mail: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``mail`` with body, headers, link groups and whether its From is unproven."""
    at, kinds = mail.columns.index(raw_col), [_WORD, pa.list_(pa.struct([("name", _WORD), ("value", _WORD)])), _WORDS, _WORDS, _WORDS, pa.bool_()]
    names = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(r or b"") for r in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]], names=[*mail_names, *names])

    mail_names = list(mail.columns)
    fields = T.StructType([*mail.schema, *T.StructType.fromDDL(PARSED)])
    return mail.mapInArrow(run, fields)


def mail_links(parsed: DataFrame, key: str = "mail_id") -> DataFrame:
    """(key, grp, pos, url): visible, hidden, then written links."""
    groups = [F.col("visible_urls"), F.col("hidden_urls"), F.col("text_urls")]
    each = F.flatten(F.array(*[_numbered(g, k) for k, g in enumerate(groups)]))
    return parsed.select(key, F.explode(each).alias("l")).select(key, "l.grp", "l.pos", "l.url")


def _numbered(group: Column, k: int) -> Column:
    return F.transform(group, lambda u, i: F.struct(F.lit(k).alias("grp"), i.alias("pos"), u.alias("url")))
