"""WARC derivatives: for each response a metadata record and a plain-text conversion record that refer to it.

derive works on a DataFrame of responses with built-in functions only. read_responses and write_records are the ends: WARC/1.1
files (plain or gzip by record) to responses, whose bytes, dates and digests go along with the decoded text, and derivative records
to .warc.gz files, one for each task (write_files), or to rows of the same bytes (write_records).
"""

from __future__ import annotations

import codecs
import gzip
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is no text, elements that end a line, and the character references that are replaced.
SILENT = ("script", "style", "noscript", "template")
BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
REFERENCES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
TEXT_TYPE, FIELDS_TYPE = "text/plain; charset=utf-8", "application/warc-fields"


def text_steps() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Pattern and replacement, one after the other, from HTML to text: those before the references are replaced and those after.

    The syntax is common to Java and RE2. White space of the source is one space, in pre too; only white space that isn't one space
    already is matched, and each step is one pass. Spaces and line ends at both ends of the text then go.
    """
    silent = "|".join([r"<!--.*?-->", *(rf"<{e}\b.*?</{e}\s*>" for e in SILENT)])
    before = [(rf"(?is){silent}", ""), (r"[ \t\r\n\f\x0B]{2,}|[\t\r\n\f\x0B]", " "), (rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n"), (r"<[^>]*>", "")]
    return before, [(r" *\n[ \n]*", "\n"), (r" {2,}", " ")]


def plain_text(html: Column) -> Column:
    before, after = text_steps()
    for a, b in before:
        html = F.regexp_replace(html, a, b)
    for a, b in REFERENCES:
        html = F.replace(html, F.lit(a), F.lit(b))
    for a, b in after:
        html = F.regexp_replace(html, a, b)
    return F.btrim(html, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A name-based identifier: the same source gives the same one again."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as the responses they would be: page_id, target_uri, source_id, http_headers, payload. Null html is an empty payload, a null url an empty target."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    return pages.select("page_id", url.alias("target_uri"), record_id(F.lit("response"), url, F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("source_id"), head.alias("http_headers"), html.alias("payload"))


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows a response: key, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, source_digest, http_headers, block.

    The metadata block (warc-fields) names source, its digest and length, its status line, media type, title and number of links;
    http_headers are the source's own, kept whole. The conversion block is the plain text; an empty one is written too. Repeated
    responses derive the same records again. No shuffle.
    """
    p, head = F.col("payload"), F.col("http_headers")
    # what read_responses adds: digest and length are then of the source's bytes
    source = [c for c in ("source_date", "source_payload_digest") if c in responses.columns]
    raw = F.col("body") if "body" in responses.columns else p
    title = F.trim(F.regexp_replace(F.regexp_extract(p, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    media = F.trim(F.regexp_extract(head, r"(?i)\ncontent-type: *([^;\r\n]*)", 1))
    lines = ("source", F.col("source_id")), ("source-digest", digest(raw)), ("source-length", F.octet_length(raw).cast("string")), ("source-status", F.regexp_extract(head, r"^([^\r\n]*)", 1)), ("source-type", media), ("title", title), ("links", F.regexp_count(p, F.lit(r"(?i)<a\s[^>]*href")).cast("string"))
    fields = F.concat(*[x for k, v in lines for x in (F.lit(f"{k}: "), v, F.lit("\r\n"))])
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit(FIELDS_TYPE).alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit(TEXT_TYPE).alias("content_type"), plain_text(p).alias("block")),
    ))
    rows = responses.select(F.col(key), "target_uri", "source_id", "http_headers", digest(raw).alias("source_digest"), *source, kinds.alias("r")).select(key, "target_uri", "source_id", "http_headers", "source_digest", *source, "r.*")
    return rows.select(
        key, "warc_type", record_id(F.col("warc_type"), F.col("source_id"), F.col("target_uri")).alias("record_id"), F.col("source_id").alias("refers_to"), "target_uri", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), "source_digest", "http_headers", "block", *source,
    )


def members(raw: bytes) -> bytes:
    """The content of a gzip file member by member; a damaged member gives what can be read of it, and the next one follows."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, at = [], 0
    while at >= 0:
        z = zlib.decompressobj(31)
        try:
            for i in range(at, len(raw), 65_536):
                out.append(z.decompress(raw[i : i + 65_536]))
                if z.eof:
                    break
            at = min(i + 65_536, len(raw)) - len(z.unused_data) if z.eof else -1
            at = raw.find(b"\x1f\x8b\x08", at) if at >= 0 else -1
        except zlib.error:
            out.append(b"\r\n")
            at = raw.find(b"\x1f\x8b\x08", at + 3)
    return b"".join(out)


def parse(raw: bytes):
    """(headers with lower-case names, block) of each record of a WARC file. After a bad line, a bad length or a record that is cut short it goes on at the next line that begins with WARC/. Values of a repeated name are joined by line ends."""
    raw, at = members(raw), 0
    starts = re.compile(rb"^WARC/", re.M)
    while m := starts.search(raw, at):
        at = m.end()
        end = re.compile(rb"\r?\n\r?\n").search(raw, at)
        if not end:
            return
        headers: dict[str, str] = {}
        for line in raw[at : end.start()].splitlines()[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            k, v = k.strip().lower(), v.strip()
            headers[k] = f"{headers[k]}\r\n{v}" if k in headers else v
        size = headers.get("content-length", "0")
        if not size.isascii() or not size.isdigit() or end.end() + int(size) > len(raw):
            continue
        at = end.end() + int(size)
        yield headers, raw[end.end() : at]


def decoded(head: str, body: bytes) -> str:
    """The text of a body by its transfer and content encodings and its charset (header, else a meta element, else UTF-8). An encoding that isn't known or doesn't decode gives no text."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.splitlines()[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        out, at = [], 0
        while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
            at = m.end() + int(m[1], 16) + 2
            out.append(body[m.end() : at - 2])
        body = b"".join(out) or body
    for name in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
            elif name != "identity":
                return ""
        except zlib.error:
            return ""
    found = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", "")) or re.search(r"(?i)<meta[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", body[:4096].decode("latin-1"))
    try:
        charset = codecs.lookup(found[1]).name if found else "utf-8"
        return body.decode("cp1252" if charset == "iso8859-1" else charset, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at path, as responses_of gives them, with the body's bytes and the source's date and payload digest; page_id is the record's place in its file."""
    names = ("page_id", "target_uri", "source_id", "http_headers", "payload", "body", "source_date", "source_payload_digest")

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for k, (h, block) in enumerate(parse(content)):
                    if h.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        head = head.decode("latin-1") + "\r\n"
                        row = (k, h.get("warc-target-uri", ""), h.get("warc-record-id", ""), head, decoded(head, body), body, h.get("warc-date", ""), h.get("warc-payload-digest", ""))
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=list(names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, target_uri string, source_id string, http_headers string, payload string, body binary, source_date string, source_payload_digest string")


def record_bytes(r: dict, date: str) -> bytes:
    """A derivative record; the source's date, declared digest and HTTP header lines are fields of it, date is for sources without one."""
    block = r["block"].encode()
    head = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r.get("source_date") or date), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r["source_digest"])]
    if r.get("source_payload_digest"):
        head.append(("WARC-Source-Declared-Payload-Digest", r["source_payload_digest"]))
    head += [("WARC-Source-HTTP-Header", x) for x in (r.get("http_headers") or "").splitlines() if x.strip()]
    head += [("Content-Type", r["content_type"]), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def write_records(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One gzip member a record, rows of (bytes) written through Spark as binary parquet; path can be in any store that Spark writes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record_bytes(r, date), mtime=0) for r in batch.to_pylist()], pa.binary())], names=["warc"])

    records.mapInArrow(run, "warc binary").write.parquet(path)


def write_files(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> list[str]:
    """part-N.warc.gz in path, a folder that all executors share, one a task with a gzip member a record; the names. A file gets its name when it is whole, so a task that is run again replaces it."""
    os.makedirs(path, exist_ok=True)

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        part, n = f"{path}/.{name}.{uuid.uuid4().hex}", 0
        with open(part, "wb") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    f.write(gzip.compress(record_bytes(r, date), mtime=0))
                    n += 1
        if not n:
            os.remove(part)
            return
        os.replace(part, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r.name for r in records.mapInArrow(run, "name string").collect())


def oracle(pages: str = "pages") -> str:
    """derive(responses_of(pages)) as DuckDB SQL."""
    sql = lambda s: "'" + s.replace("'", "''") + "'"
    text, (before, after) = "payload", text_steps()
    swap = lambda a, b: f"regexp_replace({text}, {sql(a)}, {sql(b).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}, 'g')"
    for a, b in before:
        text = swap(a, b)
    for a, b in REFERENCES:
        text = f"replace({text}, {sql(a)}, {sql(b)})"
    for a, b in after:
        text = swap(a, b)
    text = f"trim({text}, ' ' || chr(10))"
    rid = lambda *p: (lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-8' || substr({h},18,3) || '-' || substr({h},21,12) || '>'")(f"sha256(concat_ws(chr(10), {', '.join(p)}))")
    nl = "chr(13) || chr(10)"
    title = r"trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g'))"
    fields = " || ".join(f"'{k}: ' || {v} || {nl}" for k, v in (("source", "source_id"), ("source-digest", "source_digest"), ("source-length", "strlen(payload)::varchar"), ("source-status", "'HTTP/1.1 200 OK'"), ("source-type", "'text/html'"), ("title", title), ("links", r"len(regexp_extract_all(payload, '(?i)<a\s[^>]*href'))::varchar")))
    return f"""
with r as (select page_id, coalesce(url,'') as target_uri, coalesce(html,'') as payload from {pages}),
s as (select *, {rid("'response'", "target_uri", "coalesce(page_id::varchar,'')")} as source_id, 'sha256:' || sha256(payload) as source_digest,
  'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(payload) || {nl} as http_headers from r),
d as (select page_id, target_uri, source_id, source_digest, http_headers, 'metadata' as warc_type, '{FIELDS_TYPE}' as content_type, {fields} as block from s
  union all select page_id, target_uri, source_id, source_digest, http_headers, 'conversion', '{TEXT_TYPE}', {text} from s)
select page_id, warc_type, {rid("warc_type", "source_id", "target_uri")} as record_id, source_id as refers_to, target_uri, content_type,
  strlen(block)::bigint as content_length, 'sha256:' || sha256(block) as block_digest, source_digest, http_headers, block from d"""
