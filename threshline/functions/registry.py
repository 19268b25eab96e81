"""The Python-backed functions by name, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threshline.functions import headers, text, urls
from threshline.sources import files, html

FUNCTIONS = {
    "html_text": html.html_text, "html_links": html.html_links, "page_flags": html.page_flags, "is_hidden_style": html.is_hidden_style, "zip_facts": files.zip_facts, "ooxml_facts": files.ooxml_facts, "ole_facts": files.ole_facts, "mime_facts": files.mime_facts,
    "sender_domains": headers.sender_domains, "display_names": headers.display_names, "decoded_header": headers.decoded_header, "nfkc": text.nfkc, "url_similarity": urls.similarity,
}


class _ZipEntries:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for e in files.zip_listing(bytes(content or b""))["entries"]:
            yield e["name"], e["size"], e["packed"], e["is_dir"]


def register(spark: SparkSession) -> None:
    """Make the functions, and the table function ``zip_entries(content)``, known to SQL."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("zip_entries", F.udtf(_ZipEntries, returnType="name string, size bigint, packed bigint, is_dir boolean"))
