"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response gives two records that name it in WARC-Refers-To and each other in WARC-Concurrent-To; both keep its HTTP
headers, date, URI and payload digest. A page's text, title, language and links are taken in Arrow batches by scans whose
time grows with the page's length alone; regular expressions with an open middle go back over a hostile page again and
again. What else there is stays in the JVM.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded

CRLF = "\r\n"
#: What visible text is, as regular expressions with what takes the match's place, in this order; visible() does the same.
TEXT_RULES = [
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", " "),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", " "),
    (r"(?is)<(?:title|head)\b[^>]*>.*?</(?:title|head)\s*>", " "),
    (r"(?i)<(?:/?(?:p|div|h[1-6]|ul|ol|table|tr|section|article|nav|header|footer|main|aside|pre|blockquote|form)|br|hr|li|td|th)\b[^>]*>", "\n"),
    (r"<[^>]*>", " "),
]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
SPACE_RULES = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def uuid_of(*parts: Column) -> Column:
    """A urn:uuid that depends on the parts alone."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII | re.IGNORECASE)


_SPANS = [(_compiled(rf"<(?:{name})\b"), _compiled(rf"</(?:{name})[\t\n\f\r ]*>")) for name in ("script", "style", "title|head")]
_TITLE = _compiled(r"<title\b"), _compiled(r"</title[\t\n\f\r ]*>")
_BLOCKS, _TAGS = _compiled(TEXT_RULES[4][0].replace("(?i)", "")), re.compile(TEXT_RULES[5][0])
_HTML, _LANG, _A, _HREF = map(_compiled, (r"<html\b", r"\blang=\"", r"<a\b", r"\bhref=\""))
_BLANKS, _BREAKS, _WHITE = re.compile(SPACE_RULES[0][0]), re.compile(SPACE_RULES[1][0]), re.compile(r"[\t\n\f\r ]+")


def elements(html: str, opener: re.Pattern, closer: re.Pattern) -> Iterator[tuple[int, int, int, int]]:
    """(start, start of content, end of content, end) of each element from an opener with its > to the first closer after
    it. An opener without one ends the search, as none after it can have one: so each sign is looked at a few times."""
    m, ends, end = opener.search(html), None, -1
    while m:
        end = end if end >= m.end() else html.find(">", m.end())
        ends = ends or [(c.start(), c.end()) for c in closer.finditer(html, m.end())]
        i = bisect_left(ends, (end + 1, 0))
        if end < 0 or i == len(ends):
            return
        yield m.start(), end + 1, *ends[i]
        m = opener.search(html, ends[i][1])


def _without(html: str, spans: Iterator[tuple[int, int, int, int]]) -> str:
    out, at = [], 0
    for start, _, _, end in spans:
        out += (html[at:start], " ")
        at = end
    return "".join(out) + html[at:] if out else html


def _comments(html: str) -> Iterator[tuple[int, int, int, int]]:
    at = html.find("<!--")
    while at >= 0 and (end := html.find("-->", at + 4)) >= 0:
        yield at, at + 4, end, end + 3
        at = html.find("<!--", end + 3)


def visible(html: str) -> str:
    """html's visible text: no scripts, styles, comments, head or tags; blocks on lines of their own. Linear in its length."""
    html = _without(html, _comments(html))
    for opener, closer in _SPANS:
        html = _without(html, elements(html, opener, closer))
    for tag, instead in ((_BLOCKS, "\n"), (_TAGS, " ")):  # a tag without > is text: what follows the last > has none
        cut = html.rfind(">") + 1
        html = tag.sub(instead, html[:cut]) + html[cut:]
    for name, sign in ENTITIES:
        html = html.replace(name, sign)
    return _BREAKS.sub("\n", _BLANKS.sub(" ", html)).strip(" \n")


def attributes(html: str, opener: re.Pattern, name: re.Pattern) -> Iterator[str]:
    """The values of name in tags, the last one in a tag, in order; a tag ends at > or with the text."""
    m = opener.search(html)
    while m:
        end = html.find(">", m.end())
        end = len(html) if end < 0 else end
        for found in reversed(list(name.finditer(html, m.end(), end))):
            close = html.find('"', found.end())
            if close >= 0:
                yield html[found.end() : close]
                m = opener.search(html, close + 1)
                break
        else:
            m = opener.search(html, end)


def facts(html: str) -> tuple[str, str, str, str]:
    """(visible text, title, declared language, a line for each link in order of appearance)."""
    title = next((html[a:b] for _, a, b, _ in elements(html, *_TITLE)), "")
    links = "".join(f"outlink: {x}{CRLF}" for x in attributes(html, _A, _HREF))
    return visible(html), _WHITE.sub(" ", title).strip(" "), next(attributes(html, _HTML, _LANG), ""), links


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of a table of pages (page_id, url, html) that were fetched at date; a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col("page_id"), uuid_of(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.lit("response")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("headers"), payload.alias("payload"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response (page_id, record_id, target_uri, date, headers, payload).

    Metadata are warc-fields: the title, the declared language, the text's digest and length, each link in order of
    appearance, repeats included. A response without a payload gives a conversion record of no length; a null URI stays
    null; responses that repeat give records that repeat, with the same ids. An element, comment or tag that isn't closed
    is text. A very long page is taken whole, in time that grows with its length. The table may be empty; columns that
    aren't named above are ignored.
    """
    bounded(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).to_pylist()
            columns = list(zip(*map(facts, pages))) or [()] * 4
            digests = ["sha256:" + hashlib.sha256(x.encode()).hexdigest() for x in pages]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in (*columns, digests))], names)

    slim = found.select("page_id", "record_id", "target_uri", "date", "headers", F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    names = [*slim.columns[:-1], "text", "title", "lang", "links", "source_digest"]
    base = slim.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*slim.dtypes[:-1], *((n, "string") for n in names[5:])]))
    fields = F.concat(
        F.lit("title: "), "title", F.lit(f"{CRLF}lang: "), "lang", F.lit(f"{CRLF}text-digest: "), digest(F.col("text")), F.lit(f"{CRLF}text-length: "),
        F.octet_length("text").cast("string"), F.lit(CRLF), "links",
    )
    ids = {kind: uuid_of(F.col("record_id"), F.lit(kind)) for kind in ("metadata", "conversion")}

    def record(kind: str, other: str, content_type: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), ids[kind].alias("new_id"), ids[other].alias("concurrent_to"), F.lit(content_type).alias("content_type"), content.alias("content"))

    both = base.select("*", F.explode(F.array(record("metadata", "conversion", "application/warc-fields", fields), record("conversion", "metadata", "text/plain", F.col("text")))).alias("r"))
    return both.select(
        "page_id", "r.record_type", F.col("r.new_id").alias("record_id"), F.col("record_id").alias("refers_to"), "r.concurrent_to", "target_uri", "date", F.col("headers").alias("source_headers"),
        "source_digest", digest(F.col("r.content")).alias("block_digest"), "r.content_type", F.octet_length("r.content").cast("long").alias("content_length"), "r.content",
    )


def serialised(records: DataFrame) -> DataFrame:
    """(page_id, warc): each derivative as the bytes of one WARC/1.1 record, source headers in X-Source-Headers lines."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    names = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    sources = F.array_join(F.transform(F.filter(F.split("source_headers", CRLF), lambda x: x != ""), lambda x: F.concat(F.lit("X-Source-Header: "), x, F.lit(CRLF))), "")
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(line(n, F.col(c).cast("string")) for n, c in names), sources, F.lit(CRLF))
    return records.select("page_id", F.encode(F.concat(head, F.col("content"), F.lit(CRLF * 2)), "UTF-8").alias("warc"))


def _header(stream: io.BufferedIOBase, what: str) -> list[tuple[str, str]]:
    lines = []
    while (line := stream.readline(1 << 20)).strip(b"\r\n"):
        if line[:1] in b" \t" and lines:  # a folded line
            lines[-1] += b" " + line.strip()
        else:
            lines.append(line.rstrip(b"\r\n"))
    if not line:
        raise ValueError(f"cut WARC record: {what}")
    pairs = [x.decode("utf-8", "replace").partition(":") for x in lines]
    return [(name.strip(), value.strip()) for name, _, value in pairs]


def parsed(data: bytes | io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header lines, block) of each record of a WARC file or stream, gzip members or plain, one record at a time; a cut or
    malformed record raises."""
    raw = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    n = 0
    try:
        while line := stream.readline(1 << 20):
            if not line.strip(b"\r\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record after {n}")
            head = _header(stream, f"number {n}")
            size = next((v for k, v in head if k.lower() == "content-length"), "")
            block = stream.read(int(size)) if size.isdigit() else b""
            if not size.isdigit() or len(block) < int(size):
                raise ValueError(f"cut WARC record: number {n}")
            yield head, block
            n += 1
    except (EOFError, zlib.error) as e:
        raise ValueError(f"cut WARC record: number {n}") from e


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block) of all records of the WARC files under path. A file is one task's, which streams it: memory
    is that of its largest record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            files, at = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
            with files.open_input_stream(at, compression=None) as stream:
                rows, size = [], 0
                for head, block in parsed(stream):
                    rows.append(([{"name": k, "value": v} for k, v in head], block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.binary())], ["path", "headers", "block"])
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.binary())], ["path", "headers", "block"])

    files = spark.read.format("binaryFile").load(path).select("path")  # lists the files; their content isn't read
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "path string, headers array<struct<name:string,value:string>>, block binary")


def _body(head: dict[str, str], data: bytes) -> str:
    """The payload of an HTTP response as text: chunks joined, decompressed, in its charset, by default UTF-8."""
    if head.get("transfer-encoding", "").lower() == "chunked":
        parts, at = [], 0
        while (end := data.find(b"\r\n", at)) >= 0 and (size := re.match(rb"[0-9a-fA-F]+", data[at:end])):
            n = int(size[0], 16)
            parts.append(data[end + 2 : end + 2 + n])
            at = end + 4 + n
            if not n:
                break
        data = b"".join(parts) if parts else data  # some crawlers join the chunks and keep the header
    if head.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            data = zlib.decompressobj(47).decompress(data)
        except zlib.error:
            pass  # stored decompressed
    charset = re.search(r"charset=[\"']?([\w.:-]+)", head.get("content-type", ""), re.I) or re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", data[:1024], re.I)
    name = charset[1] if charset else "utf-8"
    try:
        return data.decode(name if isinstance(name, str) else name.decode(), "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def http_responses(records: DataFrame) -> DataFrame:
    """Response records for derivatives, of the records (headers, block) of read_warc: those of type response, their block
    parted into HTTP headers and payload, with the record's own id, URI and date. page_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lines, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of = {x["name"].lower(): x["value"] for x in lines or []}
                if of.get("warc-type") != "response" or not (block or b"").startswith(b"HTTP/"):
                    continue
                head, _, data = block.partition(b"\r\n\r\n")
                text = head.decode("utf-8", "replace") + CRLF
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.split(CRLF)[1:])}
                rows.append((None, of.get("warc-record-id"), of.get("warc-target-uri"), of.get("warc-date"), text, _body(http, data)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(columns)], names)

    names = ["page_id", "record_id", "target_uri", "date", "headers", "payload"]
    return records.select("headers", "block").mapInArrow(run, "page_id long, " + ", ".join(f"{n} string" for n in names[1:]))


DATE = "2025-01-01T00:00:00Z"


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    escaped = lambda x: quoted(x) if "\n" not in x else "chr(10)"
    text = "payload"
    for pattern, instead in TEXT_RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {escaped(instead)}, 'g')"
    for name, sign in ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(sign)})"
    for pattern, instead in SPACE_RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {escaped(instead)}, 'g')"
    crlf = "chr(13) || chr(10)"
    uuid = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    sha = lambda x: f"'sha256:' || sha256({x})"
    return f"""
WITH base AS (SELECT page_id, url, coalesce(html, '') AS payload, {uuid("coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|response'")} AS rid FROM pages),
done AS (SELECT *, {text} AS txt FROM base),
recs AS (
  SELECT *, 'conversion' AS record_type, 'metadata' AS other, 'text/plain' AS content_type, txt AS content FROM done
  UNION ALL
  SELECT *, 'metadata', 'conversion', 'application/warc-fields',
    'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g'))
    || {crlf} || 'lang: ' || regexp_extract(payload, '(?i)<html\\b[^>]*\\blang="([^"]*)"', 1) || {crlf} || 'text-digest: ' || {sha("txt")} || {crlf}
    || 'text-length: ' || octet_length(encode(txt)) || {crlf}
    || array_to_string(list_transform(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1), lambda x: 'outlink: ' || x || {crlf}), '')
  FROM done
)
SELECT page_id, record_type, {uuid("rid || '|' || record_type")} AS record_id, rid AS refers_to, {uuid("rid || '|' || other")} AS concurrent_to, url AS target_uri, '{DATE}' AS date,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(payload)) || {crlf} AS source_headers,
  {sha("payload")} AS source_digest, {sha("content")} AS block_digest, content_type, octet_length(encode(content)) AS content_length, content
FROM recs
"""


ORACLE = _oracle()
