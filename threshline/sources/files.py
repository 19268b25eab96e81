"""Attachments: types by signature and name, archives, Office packages, calendars and PDF markers."""

from __future__ import annotations

import email
import email.policy
import gzip
import io
import re
import struct
import unicodedata
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.functions import dims, text, urls

ENTRIES, INNER, INNER_BYTES, TOTAL, RATIO = 500, 5, 5 << 20, 15 << 20, 100
OOXML = [v for k, v in dims.MIME_BY_EXT.items() if len(k) == 4 and k[-1] in "xmb" and "vnd" in v]
LEGACY = [dims.MIME_BY_EXT[k] for k in ("doc", "xls", "ppt")]


def magic_type(content: Column) -> Column:
    """The type that a file's first bytes prove, else null."""
    head = F.hex(F.substring(content, 1, 16))
    tests = [("255044462D", "application/pdf"), ("504B", "application/zip"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.coalesce(*[F.when(head.startswith(h), mime) for h, mime in tests], F.when(webp, "image/webp"))


def archive_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("526172211A0700") | head.startswith("526172211A070100"), "rar").when(head.startswith("377ABCAF271C"), "7z")


def sniff_type(filename: Column, content: Column, hint: Column) -> Column:
    """Signature first (an Office name tells which package), then page marks, extension, and the client's hint."""
    by_ext = F.try_element_at(F.create_map(*[F.lit(x) for k, v in dims.MIME_BY_EXT.items() for x in (k, v)]), text.extension(filename))
    magic = magic_type(content)
    start = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    office = magic.isin("application/zip", "application/x-ole-storage") & by_ext.isin(OOXML + LEGACY)
    texty = by_ext.isNull() | by_ext.startswith("text/")
    page = start.rlike("<!doctype html|<html|<head|<form|<body|<script")
    claimed = F.when(hint.contains("/"), F.trim(F.split_part(F.lower(hint), F.lit(";"), F.lit(1))))
    return (
        F.when(office, by_ext)
        .when(magic.isNotNull(), magic)
        .when(texty & page, "text/html")
        .when((texty | (by_ext == "image/svg+xml")) & start.contains("<svg"), "image/svg+xml")
        .when(by_ext.isNotNull(), by_ext)
        .when(F.left(F.ltrim(F.left(start, F.lit(16))), F.lit(4)) == "<!--", "text/html")
        .when(start.startswith("bm"), "image/bmp")
        .otherwise(F.coalesce(claimed, F.lit("application/octet-stream")))
    )


def pdf_markers(content: Column) -> Column:
    """Flags of the markers that a PDF's bytes hold, each once, in order."""
    raw = F.decode(content, "ISO-8859-1")
    return F.array_distinct(F.array_compact(F.array(*[F.when(raw.contains(k), flag) for k, flag in dims.PDF_MARKERS.items()])))


def pdf_links(content: Column) -> Column:
    raw = F.decode(content, "ISO-8859-1")
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(r"/URI\s*\(([^()\\]{1,2048})\)"), F.lit(1)))


def dangerous_type(filename: Column) -> Column:
    """Flags of a file by its name alone, null for other files."""
    flags = text.name_flags(filename)
    risky = F.arrays_overlap(flags, dims.words(["executable_in_archive", "script_in_archive", "shortcut_in_archive", "double_extension"]))
    more = F.when(F.array_contains(flags, "double_extension"), F.array(F.lit("dangerous_file_type"), F.lit("double_extension"))).otherwise(F.array(F.lit("dangerous_file_type")))
    return F.when(text.extension(filename).isin(dims.DISK_IMAGE_EXTS), F.array(F.lit("disk_image_attachment"))).when(risky, more)


def calendar_facts(content: Column) -> dict[str, Column]:
    """Organizer, read text, links and flags of a calendar invite."""
    t = F.regexp_replace(text.without_invisible(F.decode(content, "UTF-8")), r"\r?\n[ \t]", "")
    lines = F.filter(F.split(t, r"\r?\n|\r"), lambda x: x.contains(":"))
    plain = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";"))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.regexp_extract(x, "^([^:;]*)", 1)).alias("k"), plain(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keep = ["SUMMARY", "DESCRIPTION", "LOCATION", "URL", "ATTACH", "X-ALT-DESC"]
    strip = lambda p: F.when(p["k"] == "X-ALT-DESC", F.regexp_replace(F.regexp_replace(p["v"], "<[^>]*>", " "), "<[^>]*$", "")).otherwise(p["v"])
    body = F.left(F.array_join(F.transform(F.filter(pairs, lambda p: p["k"].isin(keep)), strip), "\n"), F.lit(20_000))
    organizer = F.try_element_at(F.filter(pairs, lambda p: p["k"] == "ORGANIZER"), F.lit(-1))["v"]
    every = F.left(F.array_join(F.transform(pairs, lambda p: p["v"]), "\n"), F.lit(200_000))
    found = F.array_distinct(F.concat(urls.urls_in_text(body), urls.urls_in_text(every)))
    flags = F.when(F.size(found) > 0, F.array(F.lit("calendar_invite"), F.lit("calendar_with_links"))).otherwise(F.array(F.lit("calendar_invite")))
    return {"organizer": F.trim(F.regexp_replace(organizer, "(?i)mailto:", "")), "extracted_text": body, "extracted_urls": found, "notable_features": flags}


def zip_listing(content: bytes) -> dict:
    """Entries, encryption and size warnings of a ZIP; a file that is none is uninspectable."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError):
        return {"entries": [], "flags": ["uninspectable_archive"], "n": 0, "encrypted": False}
    flags = []
    files = [i for i in infos if not i.filename.endswith(("/", "\\"))]
    encrypted = any(i.flag_bits & 1 for i in files)
    if encrypted:
        flags.append("encrypted_archive")
    if any(i.compress_size and i.file_size / i.compress_size > RATIO and i.file_size > 1 << 20 for i in files):
        flags.append("zip_bomb_suspected")
    rows = [{"name": i.filename, "plain": unicodedata.normalize("NFKC", i.filename), "size": i.file_size, "packed": i.compress_size, "is_dir": i.filename.endswith(("/", "\\"))} for i in infos[:ENTRIES]]
    return {"entries": rows, "flags": flags, "n": len(infos), "encrypted": encrypted}


_WORDS = T.ArrayType(T.StringType())
_ENTRY = T.ArrayType(T.StructType().add("name", "string").add("plain", "string").add("size", "long").add("packed", "long").add("is_dir", "boolean"))


@F.pandas_udf(T.StructType().add("entries", _ENTRY).add("flags", _WORDS).add("n", "integer").add("encrypted", "boolean"))
def zip_facts(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([zip_listing(bytes(c or b"")) for c in contents], columns=["entries", "flags", "n", "encrypted"])


def analyse_zip(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` with entries, entry_count, encrypted and notable_features (names, then sizes)."""
    d = files.withColumn("_z", zip_facts(F.col(content_col)))
    names = F.transform(F.filter("_z.entries", lambda e: ~e["is_dir"]), lambda e: e["plain"])
    flags = F.array_distinct(F.concat(text.classify_names(names, True), F.col("_z.flags")))
    return d.select(*files.columns, F.col("_z.entries").alias("entries"), F.col("_z.n").alias("entry_count"), F.col("_z.encrypted").alias("encrypted"), flags.alias("notable_features"))


#: Inner files are read in this order (fixed values).
INNER_ORDER = ["html htm xhtml shtml svg mht mhtml eml", "pdf", "doc docx docm dotx dotm xls xlsx xlsm xlsb xltx xltm ppt pptx pptm potx potm ppsx ppsm rtf", "ics", "txt csv", "jpg jpeg png gif"]


def choose_inner(entries: Column) -> Column:
    """The members to open: by kind, then as listed, within the count and byte budgets; a member over the budget is passed over."""
    ext = lambda e: F.lower(F.regexp_extract(e["name"], r"\.([A-Za-z0-9]+)$", 1))
    kind = lambda e: F.coalesce(*[F.when(ext(e).isin(k.split()), i) for i, k in enumerate(INNER_ORDER)])
    known = F.filter(F.transform(entries, lambda e, i: F.struct(kind(e).alias("kind"), i.alias("at"), e["name"].alias("name"), e["size"].alias("size"), e["is_dir"].alias("dir"))), lambda e: ~e["dir"] & e["kind"].isNotNull())
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        ok = (F.size(acc["out"]) < INNER) & (e["size"] <= INNER_BYTES) & (acc["used"] + e["size"] <= TOTAL)
        return F.struct((acc["used"] + F.when(ok, e["size"]).otherwise(0)).cast("bigint").alias("used"), F.when(ok, F.concat(acc["out"], F.array(e["name"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(known), zero, step)["out"]


def member_report(files: DataFrame, key: str) -> DataFrame:
    """Risky members of archives with their reasons, most reasons first, twenty a file."""
    reasons = F.create_map(*[F.lit(x) for k, v in dims.NAME_REASONS.items() for x in (k, v)])
    d = files.select(key, F.posexplode("entries").alias("pos", "e")).withColumn("reasons", F.transform(text.name_flags(F.col("e.name")), lambda f: F.try_element_at(reasons, f)))
    d = d.where(F.size("reasons") > 0).select(key, "pos", F.col("e.name").alias("name"), "reasons")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.size("reasons")).alias("n"), "pos", "name", "reasons"))), 1, 20)
    return d.groupBy(key).agg(best.alias("m")).select(key, F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["reasons"].alias("reasons"))).alias("members"))


def _xml_text(raw: bytes) -> tuple[str, bool]:
    """Text of an Office part; a part with a document type is refused."""
    if b"<!DOCTYPE" in raw[:4096].upper() or b"<!ENTITY" in raw.upper():
        return "", True
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return "", False
    out = []
    for el in root.iter():
        name = el.tag.rpartition("}")[2]
        if name == "t" and el.text:
            out.append(el.text)
        elif name in ("p", "br", "tab", "row", "si"):
            out.append("\n")
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(out).split("\n")) if x), False


def office_package(content: bytes) -> dict:
    """Kind, text, links and flags of a modern Office file."""
    out = {"kind": None, "extracted_text": "", "extracted_urls": [], "notable_features": []}
    flags, links, texts = [], [], []
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError):
        return out
    names = z.namelist()
    out["kind"] = next((k for k, p in (("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/")) if any(n.lower().startswith(p) for n in names)), None)
    number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n.lower())]
    for n in sorted(names[:3000], key=number):
        low = n.lower()
        for part, flag in (("vbaproject", "contains_macros"), ("activex", "contains_activex"), ("oleobject", "embedded_ole_object"), ("/embeddings/", "embeds_another_file"), ("connections.xml", "external_data_connection"), ("macrosheets/", "contains_macros")):
            if part in low:
                flags.append(flag)
        if not low.endswith((".xml", ".rels")) or z.getinfo(n).file_size > 20 << 20:
            continue
        raw = z.read(n)
        if low.endswith(".rels"):
            for kind, target in re.findall(r'Type="[^"]*/([^"/]+)"[^>]*?Target="([^"]+)"', raw.decode("utf-8", "replace")) + [(k, t) for t, k in re.findall(r'Target="([^"]+)"[^>]*?Type="[^"]*/([^"/]+)"', raw.decode("utf-8", "replace"))]:
                if target.lower().startswith(("http://", "https://")):
                    links.append(target)
                    if kind in ("attachedTemplate", "frame", "subDocument"):
                        flags.append("remote_template")
                    elif kind == "oleObject":
                        flags.append("embedded_ole_object")
        elif low.startswith(("word/document", "word/header", "word/footer", "xl/sharedstrings", "ppt/slides/slide", "word/comments")):
            body, refused = _xml_text(raw)
            texts.append(body)
            if refused:
                flags.append("suspicious_xml_doctype")
            fields = " ".join(re.findall(r"<w:instrText[^>]*>([^<]*)</w:instrText>", raw.decode("utf-8", "replace")))
            if re.search(r"\bDDE(?:AUTO)?\b", fields):
                flags.append("dde_field")
            links += re.findall(r'HYPERLINK\s+"?(https?://[^\s"]+)', fields)
    body = "\n".join(t for t in texts if t)[:20_000]
    links += re.findall(r"https?://[^\s\"'<>)\]}]+", body)
    return out | {"extracted_text": body, "extracted_urls": list(dict.fromkeys(links))[:200], "notable_features": list(dict.fromkeys(flags))}


@F.pandas_udf(T.StructType().add("kind", "string").add("extracted_text", "string").add("extracted_urls", _WORDS).add("notable_features", _WORDS))
def ooxml_facts(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([office_package(bytes(c or b"")) for c in contents], columns=["kind", "extracted_text", "extracted_urls", "notable_features"])


def compound_names(content: bytes) -> list[str]:
    """Names in the directory of a compound file, following its sector chain."""
    if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(content) < 512:
        return []
    shift, first = struct.unpack_from("<H", content, 30)[0], struct.unpack_from("<I", content, 48)[0]
    size = 1 << min(shift, 12)
    fat: list[int] = []
    for s in struct.unpack_from("<109I", content, 76):
        at = 512 + s * size
        if s < 0xFFFFFFFA and at + size <= len(content):
            fat += struct.unpack_from(f"<{size // 4}I", content, at)
    names, sector, seen = [], first, set()
    while sector < 0xFFFFFFFA and sector not in seen and len(names) < 5000:
        seen.add(sector)
        base = 512 + sector * size
        for at in range(base, min(base + size, len(content) - 127), 128):
            n = struct.unpack_from("<H", content, at + 64)[0]
            if 2 <= n <= 64 and content[at + 66] in (1, 2, 5):
                names.append(content[at : at + n - 2].decode("utf-16-le", "replace"))
        sector = fat[sector] if sector < len(fat) else 0xFFFFFFFE
    return names


def legacy_office(content: bytes) -> dict:
    """Flags and links of a legacy Office file."""
    names = {n.lower() for n in compound_names(content)}
    flags = ["legacy_office_format"]
    if names & {"macros", "vba", "_vba_project", "_vba_project_cur"}:
        flags.append("contains_macros")
    if names & {"encryptedpackage", "encryptioninfo"}:
        flags.append("encrypted_document")
    if any(n.startswith(("\x01ole10native", "objectpool", "mbd")) for n in names):
        flags.append("embedded_ole_object")
    flat = content.replace(b"\x00", b"")
    if re.search(rb"\bDDE(?:AUTO)?\b", flat):
        flags.append("dde_field")
    found = [u.decode("ascii", "ignore") for u in re.findall(rb"https?://[\x21-\x7e]{4,2048}", flat)]
    return {"notable_features": flags, "extracted_urls": list(dict.fromkeys(found))[:200]}


@F.pandas_udf(T.StructType().add("notable_features", _WORDS).add("extracted_urls", _WORDS))
def ole_facts(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([legacy_office(bytes(c or b"")) for c in contents], columns=["notable_features", "extracted_urls"])


def mime_pages(content: bytes) -> dict:
    """A web archive or saved mail: its pages read as pages, its plain text where it has none, its other files named."""
    from threshline.sources import html

    m = email.message_from_bytes(content[: 10 << 20], policy=email.policy.compat32)
    flags, texts, found, plain, names, attached, pages = [], [], [], [], [], False, 0
    for part in m.walk():
        kind, name, data = part.get_content_type(), part.get_filename(), None if part.is_multipart() else part.get_payload(decode=True)
        if name:
            names.append(str(name))
        if not isinstance(data, bytes):
            continue
        page = kind in ("text/html", "application/xhtml+xml", "image/svg+xml")
        if page and pages < 3:
            pages += 1
            p = data.decode(part.get_content_charset() or "utf-8", "replace")
            facts = html.read(p).facts
            flags += [flag for fact, flag in html.FLAGS if fact in facts]
            texts.append(html.to_text(p))
            found += html.link_groups(p)[0]
        elif kind == "text/plain" and not name:
            plain.append(data.decode(part.get_content_charset() or "utf-8", "replace"))
        elif name and not kind.startswith(("image/", "font/")) and kind != "text/css":
            attached = True
    body = "\n".join(texts) if pages else "\n".join(plain[:1])
    if not pages:
        found = html.URL.findall(body)
    flags += ["inner_files_not_extracted"] if attached else []
    return {"names": [unicodedata.normalize("NFKC", n) for n in names], "extracted_text": body[:20_000], "extracted_urls": list(dict.fromkeys(found))[:200], "notable_features": list(dict.fromkeys(flags))}


@F.pandas_udf(T.StructType().add("names", _WORDS).add("extracted_text", "string").add("extracted_urls", _WORDS).add("notable_features", _WORDS))
def mime_facts(contents: pd.Series) -> pd.DataFrame:
    none = {"names": [], "extracted_text": "", "extracted_urls": [], "notable_features": []}
    return pd.DataFrame([mime_pages(bytes(c)) if c else none for c in contents], columns=list(none))


def uninspectable(kind: Column) -> Column:
    """Flags of an archive that nothing here can open."""
    return F.when(kind.isin("rar", "7z"), F.array(F.lit("uninspectable_archive")))


def decoded_upload(encoded: Column, most: int = 10 << 20) -> Column:
    """Base64 content within the size limit, else null."""
    raw = F.try_to_binary(encoded, F.lit("base64"))
    return F.when(F.length(raw) <= most, raw)


def merged_flags(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


_PDF_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>){0,4000})>>\s*stream\r?\n")
_PDF_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\[\]()]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(T\*|(?:Td|TD|ET)\b)", re.S)
_PDF_ESCAPE = {b"n": b"\n", b"r": b"\n", b"t": b" ", b"b": b"", b"f": b""}


def pdf_streams(content: bytes, most: int = 20 << 20) -> list[bytes]:
    """A PDF's streams, inflated where they are deflated, within a total size."""
    out, left = [], most
    for m in _PDF_STREAM.finditer(content):
        end = content.find(b"endstream", m.end())
        raw = content[m.end() : end if end >= 0 else len(content)]
        if b"FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw, left)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        out.append(raw[:left])
        left -= len(out[-1])
        if left <= 0:
            break
    return out


def pdf_facts(content: bytes) -> dict:
    """Text that a PDF's plain content streams show, its links, and the flags of its markers, in streams too."""
    streams = pdf_streams(content)
    plain = lambda raw: re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPE.get(m[1], m[1]), raw, flags=re.S)
    shown = []
    for raw in streams:
        if b"Tj" not in raw and b"TJ" not in raw:
            continue
        for m in _PDF_SHOWN.finditer(raw):
            if m[3]:
                shown.append("\n")
            elif m[1] is not None:
                shown.append(plain(m[1]).decode("latin-1"))
            else:
                shown += [plain(x).decode("latin-1") for x in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", m[2])]
    body = "\n".join(x for x in (" ".join(line.split()) for line in "".join(shown).split("\n")) if x)[:20_000]
    every = [content, *streams]
    links = [u.decode("latin-1") for raw in every for u in re.findall(rb"/URI\s*\(([^()\\]{1,2048})\)", raw)] + re.findall(r"https?://[^\s\"'<>)\]}]+", body)
    flags = [flag for mark, flag in dims.PDF_MARKERS.items() if any(mark.encode() in raw for raw in every)]
    return {"extracted_text": body, "extracted_urls": list(dict.fromkeys(links))[:200], "notable_features": list(dict.fromkeys(flags))}


def page_source(content: bytes) -> dict:
    from threshline.sources import html

    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.GzipFile(fileobj=io.BytesIO(content)).read(20 << 20)
        except (OSError, EOFError):
            pass
    shown, visible, _, flags = html.told(content.decode("utf-8", "replace"))
    return {"extracted_text": shown, "extracted_urls": visible, "notable_features": flags}


def plain_file(content: bytes) -> dict:
    body = content.decode("utf-8", "replace")
    return {"extracted_text": body[:20_000], "extracted_urls": list(dict.fromkeys(u.rstrip(".,;:!?") for u in re.findall(r"https?://[^\s\"'<>)\]}]+", body)))[:200], "notable_features": []}


def invite_file(content: bytes) -> dict:
    """What an invite's summary, description and place say, and every link in it."""
    lines = re.sub(r"\r?\n[ \t]", "", content.decode("utf-8", "replace")).splitlines()
    plain = lambda v: v.replace("\\n", "\n").replace("\\,", ",").replace("\\;", ";")
    pairs = [(x.partition(":")[0].partition(";")[0].upper(), plain(x.partition(":")[2])) for x in lines if ":" in x]
    body = "\n".join(re.sub("<[^>]*>", " ", v) for k, v in pairs if k in ("SUMMARY", "DESCRIPTION", "LOCATION", "URL", "ATTACH", "X-ALT-DESC"))[:20_000]
    found = list(dict.fromkeys(re.findall(r"https?://[^\s\"'<>)\]}]+", "\n".join([body, *[v for _, v in pairs]]))))[:200]
    return {"extracted_text": body, "extracted_urls": found, "notable_features": ["calendar_invite", *(["calendar_with_links"] if found else [])]}


def member_flags(name: str) -> list[str]:
    """``text.name_flags`` of one member's name, which is in compatibility form already."""
    bidi = re.search("[\u200e\u200f\u202a-\u202e\u2066-\u2069]", name)
    base = re.sub(r"[\s.\x85\xa0]+$", "", re.sub(r"^.*[/\\]", "", "".join(c for c in name if not _unseen(c)).translate(_DOTS), flags=re.S))
    parts = [p.strip(" ") for p in base.lower().split(".")]
    ext = parts[-1] if len(parts) > 1 else ""
    runs = dims.EXECUTABLE_EXTS + dims.SCRIPT_EXTS + dims.SHORTCUT_EXTS
    double = len(parts) >= 3 and parts[-2] in dims.DOCUMENT_EXTS and ext in runs
    kinds = ((dims.EXECUTABLE_EXTS, "executable_in_archive"), (dims.SCRIPT_EXTS, "script_in_archive"), (dims.SHORTCUT_EXTS, "shortcut_in_archive"), (dims.DISK_IMAGE_EXTS, "disk_image_in_archive"), (dims.ARCHIVE_EXTS, "nested_archive"))
    return [*(["double_extension"] if double or bidi else []), *[flag for exts, flag in kinds if ext in exts][:1]]


_DOTS = str.maketrans("。｡﹒", "...")
_FILLERS = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180F, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10), *range(0xFFF0, 0xFFF9), *range(0xE0000, 0xE1000)])


def _unseen(c: str) -> bool:
    return c not in "\t\n\x0c\r" and (unicodedata.category(c) in ("Cf", "Cc") or ord(c) in _FILLERS)


#: Readers of the members of an archive, by extension; more telling kinds are opened first.
INNER_READERS = dict(zip(INNER_ORDER[:5], (page_source, pdf_facts, office_package, invite_file, plain_file), strict=True))


def inner_reader(name: str, content: bytes):
    ext = name.rpartition(".")[2].lower()
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return legacy_office
    if content[:5] == b"%PDF-":
        return pdf_facts
    if ext in ("eml", "mht", "mhtml"):
        return mime_pages
    return next((r for k, r in INNER_READERS.items() if ext in k.split()), None)


def zip_contents(content: bytes) -> dict:
    """An archive's listing with its flags, and the facts of the members that are opened."""
    listing = zip_listing(content)
    flags, inner, total = list(listing["flags"]), [], 0
    kind = lambda n: next((i for i, k in enumerate(INNER_ORDER) if n.rpartition(".")[2].lower() in k.split()), None)
    known = [(kind(e["name"]), i, e) for i, e in enumerate(listing["entries"]) if not e["is_dir"] and "." in e["name"] and kind(e["name"]) is not None]
    for _, _, e in sorted(known, key=lambda x: x[:2]):
        if len(inner) >= INNER:
            break
        if e["size"] > INNER_BYTES or total + e["size"] > TOTAL:
            flags.append("oversized_inner_file")
            continue
        if e["size"] / max(e["packed"], 1) > RATIO:
            flags.append("zip_bomb_suspected")
            continue
        total += e["size"]
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(e["name"]) as f:
                data = f.read(INNER_BYTES)
            reader = inner_reader(e["name"], data)
            facts = reader(data) if reader else {}
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, ValueError, KeyError, EOFError, OSError, zlib.error, struct.error):
            flags.append("inner_files_not_extracted")
            continue
        inner.append({"name": e["plain"], "extracted_text": facts.get("extracted_text", ""), "extracted_urls": facts.get("extracted_urls", []), "notable_features": facts.get("notable_features", [])})
    own = [x for i in inner for x in i["notable_features"]]
    return {
        "names": [e["plain"] for e in listing["entries"] if not e["is_dir"]], "inner": inner, "extracted_text": "\n".join(i["extracted_text"] for i in inner if i["extracted_text"])[:20_000],
        "extracted_urls": list(dict.fromkeys(u for i in inner for u in i["extracted_urls"]))[:200], "notable_features": list(dict.fromkeys([*flags, *own])),
    }


def any_file(kind: str, content: bytes) -> dict:
    """The facts of a file of a kind that Python reads."""
    if kind == "archive_zip":
        got, office = zip_contents(content), office_package(content)
        if office["kind"]:  # an Office file under another name is both
            got |= {k: office[k] for k in ("extracted_text", "extracted_urls")} | {"notable_features": list(dict.fromkeys([*got["notable_features"], *office["notable_features"]]))}
        return got
    return {"pdf": pdf_facts, "office": office_package, "office_legacy": legacy_office, "mime": mime_pages, "page": page_source, "calendar": invite_file, "text": plain_file}[kind](content)


def kind_of(mime: str, danger: list[str] | None, packed: str | None) -> str:
    """How a file is read, by its type and by what its name and first bytes say."""
    if danger is not None:
        return "disk_image" if "disk_image_attachment" in danger else "executable"
    if packed:
        return "archive"
    if mime in OOXML:
        return "office"
    if mime in (*LEGACY, "application/x-ole-storage"):
        return "office_legacy"
    known = {"application/pdf": "pdf", "application/zip": "archive_zip", "text/calendar": "calendar", "text/html": "page", "application/xhtml+xml": "page", "image/svg+xml": "page", "multipart/related": "mime", "message/rfc822": "mime"}
    return known.get(mime) or {"image": "image", "text": "text"}.get(mime.partition("/")[0], "unsupported")


_FACTS = T.StructType().add("type", "string").add("kind", "string").add("names", T.ArrayType(T.StructType().add("name", "string").add("flags", _WORDS))).add("extracted_text", "string").add("extracted_urls", _WORDS).add("notable_features", _WORDS)
_FACTS = _FACTS.add("inner", T.ArrayType(T.StructType().add("name", "string").add("extracted_text", "string").add("extracted_urls", _WORDS).add("notable_features", _WORDS)))


@F.pandas_udf(_FACTS)
def file_facts(types: pd.Series, dangers: pd.Series, packed: pd.Series, contents: pd.Series) -> pd.DataFrame:
    """One reading of each file; files without content have no facts but those of their name."""

    def one(mime: str, danger: list[str] | None, archive: str | None, content: bytes | None) -> dict:
        danger = None if danger is None else list(danger)
        kind = kind_of(mime or "", danger, archive)
        got: dict = {}
        if kind in ("executable", "disk_image"):
            got = {"notable_features": danger}
        elif kind == "archive":
            got = {"notable_features": ["uninspectable_archive"]}
        elif content is not None and kind not in ("image", "unsupported"):
            got = any_file(kind, bytes(content))
        names = [{"name": n, "flags": member_flags(n)} for n in got.get("names", [])]
        flags = list(dict.fromkeys([*(f for n in names for f in n["flags"]), *got.get("notable_features", [])]))
        return {"type": mime, "kind": kind, "names": names, "extracted_text": got.get("extracted_text", ""), "extracted_urls": got.get("extracted_urls", []), "notable_features": flags, "inner": got.get("inner", [])}

    return pd.DataFrame([one(*row) for row in zip(types, dangers, packed, contents, strict=True)], columns=[f.name for f in _FACTS])


#: Flags of inner files that explain a verdict (fixed values).
INNER_REASONS = {
    "contains_macros": "macros", "remote_template": "remote template", "dde_field": "DDE field", "contains_activex": "ActiveX control", "embedded_ole_object": "embedded object", "contains_javascript": "JavaScript",
    "auto_execute_on_open": "runs on open", "launch_external_action": "launches a program", "contains_password_field": "password form", "submits_form_to_url": "sends a form", "encrypted_document": "password-protected", "contains_qr_code": "QR code",
}


def archive_report(names: Column, inner: Column, bad_urls: Column) -> Column:
    """Members that explain a verdict, (name, reasons), most reasons first, twenty at most: risky names (name, flags), risky contents, flagged links."""
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    reasons = lambda flags, d: F.filter(F.transform(flags, lambda f: F.try_element_at(table(d), f)), lambda r: r.isNotNull())
    flagged = lambda u: F.when(F.arrays_overlap(u, bad_urls), F.array(F.lit("flagged link"))).otherwise(F.array().cast("array<string>"))

    def row(member: Column, i: Column) -> Column:
        name = member["name"]
        own = F.filter(inner, lambda x: x["name"] == name)
        more = F.flatten(F.transform(own, lambda x: F.concat(reasons(x["notable_features"], INNER_REASONS), flagged(x["extracted_urls"]))))
        all_ = F.array_distinct(F.concat(reasons(member["flags"], dims.NAME_REASONS), more))
        return F.struct((-F.size(all_)).alias("n"), i.alias("at"), name.alias("name"), all_.alias("reasons"))

    rows = F.array_sort(F.filter(F.transform(names, row), lambda x: x["n"] < 0))
    return F.transform(F.slice(rows, 1, 20), lambda x: F.struct(x["name"].alias("name"), x["reasons"].alias("reasons")))


#: What can run without further programs: the rest is reported, not read.
CAPABILITIES = {"html": True, "zip": True, "ooxml": True, "ole": True, "ics": True, "pdf_markers": True, "pdf_text": True, "ocr": False, "qr": False, "rar": False, "7z": False}


def analyse(files: DataFrame) -> DataFrame:
    """(…, type, kind, notable_features, extracted_text, extracted_urls, names, inner) of attachments (id, filename, content, mime), without their content.

    One pass: type, name and first bytes are judged by built-in functions, and each file is then read once.
    """
    d = files.withColumn("_f", file_facts(sniff_type(F.col("filename"), F.col("content"), F.col("mime")), dangerous_type(F.col("filename")), archive_kind(F.col("content")), F.col("content")))
    kept = [c for c in files.columns if c != "content"]
    return d.select(*kept, *[F.col(f"_f.{f.name}").alias(f.name) for f in _FACTS])
