"""WARC derivatives: responses become linked metadata records and plain-text conversion records.

Records are rows: type, id, the id they refer to, target URI, date, content type, block, digests, and headers kept from their source. A
conversion holds the text of the response's HTML; a metadata record tells its source's record id, date, target and digests,
its status line and every one of its HTTP headers, and the page's title. Both refer to the response. ``write_warc`` writes rows as
WARC/1.1 files through Spark's text writer (a record's end is the line separator), so that any file system will do; Spark's
codecs compress a file as one member, not each record. ``read_warc`` reads files again, of one or many members.

All of it is expressions: no Python on the way to the files. Pages have no date of their own: it is an argument, or their column
``date``. Null html: an empty payload, whose derivatives are empty or say so; null URL: an empty target; null ids get records of their
own; repeated rows give equal records; very long pages are converted whole; an empty table gives an empty result; columns beside the
records' own stay in ``derivatives``, whatever their names. The reader leaves out records without a length, cut records, and what
follows a broken compressed member; header names count in any case.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
COLUMNS = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block", "block_digest", "payload_digest"]

#: Steps from HTML to text: pattern, replacement. RE2 and Java read them alike.
TEXT_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)[^>]*>", ""),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|aside|title|head|body|html|blockquote|pre|hr)( [^>]*|/)?>", "\n"),
    (r"(?s)<[^>]*>", ""),
]
SPACE_STEPS = [(r"[ \t\r\f\x{00A0}]+", " "), (r" ?\n[ \n]*", "\n")]
ENTITY = r"^(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _record_id(*parts: Column | str) -> Column:
    """A urn:uuid from a hash, so that reruns give the same ids."""
    m = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cut = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescaped(text: Column) -> Column:
    """``text`` with its character references, named and numeric, replaced once; those that name no character stay or become U+FFFD."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))], F.lit("apos"), F.lit("'"))

    def piece(x):
        found = F.regexp_extract(x, ENTITY, 0)
        name = F.rtrim(found, F.lit(";"))
        hexed = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        by = F.when(found == "", None).when(name.startswith("#"), numeric).otherwise(F.try_element_at(named, name))
        return F.coalesce(F.concat(by, F.substr(x, F.length(found) + 1)), F.concat(F.lit("&"), x))

    def joined(parts):
        return F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), piece)), "")

    return _once(text, lambda t: F.when(t.contains("&"), _once(F.split(t, "&"), joined)).otherwise(t))


def html_text(html: Column) -> Column:
    for pattern, by in TEXT_STEPS:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(by))
    html = unescaped(html)
    for pattern, by in SPACE_STEPS:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(by))
    return F.btrim(html, F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html; date, if it is there, as text), with page_id."""
    when = F.coalesce(F.col("date"), F.lit(date)) if "date" in pages.columns else F.lit(date)
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head, html)
    return pages.select(
        "page_id", F.lit("response").alias("record_type"), _record_id("response", F.col("page_id"), F.col("url")).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), F.coalesce("url", F.lit("")).alias("target_uri"), when.alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), block.alias("block"),
        _digest(block).alias("block_digest"), _digest(html).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response of ``records``; their columns beside COLUMNS stay."""
    own = [c for c in records.columns if c not in COLUMNS]
    parts = F.split("block", "\r\n\r\n", 2)
    r = records.where("record_type = 'response'").select(
        F.struct(*own or [F.lit(1)]).alias("row"), F.col("record_id").alias("source"), "target_uri", "date", "block_digest", "payload_digest",
        F.split(F.get(parts, F.lit(0)), "\r\n").alias("head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("html"),
    )
    title = F.btrim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(r"[ \t\r\n\f]+"), F.lit(" ")), F.lit(" "))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    fields = F.concat(
        F.array(
            field("source-record-id", F.concat(F.lit("<"), F.col("source"), F.lit(">"))), field("source-target-uri", F.col("target_uri")),
            field("source-date", F.col("date")), field("source-block-digest", F.col("block_digest")),
            field("source-payload-digest", F.col("payload_digest")), field("source-status", F.get("head", F.lit(0))),
        ),
        F.transform(F.filter("head", lambda x, i: (i > 0) & (x != "")), lambda x: field("source-header", x)),
        F.array(field("title", unescaped(title))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), F.array_join(fields, "\r\n").alias("body")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("type"), html_text(F.col("html")).alias("body")),
    )
    out = r.select("row", "source", "target_uri", "date", "payload_digest", F.explode(kinds).alias("new"))
    return out.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("new.kind").alias("record_type"), _record_id(F.col("new.kind"), F.col("source")).alias("record_id"),
        F.col("source").alias("refers_to"), "target_uri", "date", F.col("new.type").alias("content_type"), F.col("new.body").alias("block"),
        _digest(F.col("new.body")).alias("block_digest"), "payload_digest",
    )


def record_text(records: DataFrame) -> Column:
    """A record's header and block, without the blank lines that end it."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    own = F.col("record_type") == "response"
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", angle(F.col("record_id"))),
        line("WARC-Refers-To", angle(F.col("refers_to"))), line("WARC-Target-URI", F.nullif(F.col("target_uri"), F.lit(""))),
        line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        F.when(own, line("WARC-Payload-Digest", F.col("payload_digest"))).otherwise(line("X-Source-Payload-Digest", F.col("payload_digest"))),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    records.select(record_text(records).alias("value")).write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_warc(data: bytes):
    """Headers, by lower-case name, and block of each whole record of a file."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        pairs = re.findall(r"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", data[at:end].decode("utf-8", "replace"))
        head = {name.strip().lower(): value.strip() for name, value in pairs}
        length = head.get("content-length", "")
        if not length.isdecimal():
            at = end
            continue
        at = end + 4 + int(length)
        if at <= len(data):
            yield head, data[end + 4 : at].decode("utf-8", "replace")


def decompressed(data: bytes) -> bytes:
    """A plain file as it is; of gzip members, all up to the first broken one."""
    import zlib

    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip, a task for each file."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_warc(decompressed(content.as_py())):
                    get = lambda name, h=head: h.get(name, "").strip("<>") or None
                    digest = get("warc-payload-digest") or get("x-source-payload-digest")
                    rows.append((get("warc-type"), get("warc-record-id"), get("warc-refers-to"), head.get("warc-target-uri", ""), get("warc-date"), get("content-type"), block, get("warc-block-digest"), digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 9, names=COLUMNS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{c} string" for c in COLUMNS))
