"""WARC derivatives: a metadata and a plain-text conversion record for each response.

The work stays in one scan without a shuffle: DataFrame expressions, and one Arrow map
that takes the tags off and decodes all character references, named or numeric.  The
responses are records of WARC files, or stored pages.
"""

from __future__ import annotations

import gzip
import html
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Parts of a page that are no text, each up to its end or, unclosed, that of the page; and tags that end a line.
HIDDEN = [r"(?is)<!--.*?(?:-->|\z)", r"(?is)<(script|style|title)\b.*?(?:</\1\s*>|\z)"]
LINE = r"(?i)<(/?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|body|html)\b[^>]*|br\s*/?)>"
TAG = re.compile("<[^>]*>")
#: References to blanks, which become plain blanks: no-break space, tab, line feed, form feed, carriage return, space.
BLANK = re.compile(r"&(?:nbsp;?|NonBreakingSpace;|Tab;|NewLine;|#0*(?:9|10|12|13|32|160)(?:;|(?![0-9]))|#[xX]0*(?:9|[aAcCdD]|20|[aA]0)(?:;|(?![0-9a-fA-F])))")
#: The date of a record whose response has none.
NO_DATE = "1970-01-01T00:00:00Z"


def uuid_of(key: Column) -> Column:
    """A record id made from a key, so that the same response always gets the same records."""
    h = F.md5(key.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def visible(page: Column) -> Column:
    """A page without its hidden parts; tags of blocks are line ends, blanks are single."""
    out = page
    for pattern in HIDDEN:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\s{2,}|[\t\n\x0B\f\r]", " "), LINE, "\n")


def decoded(text: str) -> str:
    """``text`` without tags and with all references decoded, by the rules of HTML 5; no reference goes across a tag."""
    if "&" not in text:
        return TAG.sub("", text)
    return "".join([html.unescape(BLANK.sub(" ", part)) for part in TAG.split(text)])


def tidy(text: Column) -> Column:
    """Blanks are single, lines neither begin nor end with one, and none is empty."""
    out = F.regexp_replace(text, "[ \n]*\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(out, " {2,}", " "), F.lit(" \n"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha-256:"), F.sha2(block.cast("binary"), 256))


RESPONSE = "source_id string, record_id string, target_uri string, date string, headers string, payload string, source_digest string"


def warc_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by their lower-case names, and block of each record of a WARC file; a file that is cut off ends with an error."""
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        headers: dict[str, str] = {}
        while (line := source.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("record headers are cut off")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = source.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("record is cut off")
        yield headers, block


def read_responses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The response records of WARC files, plain or gzipped, in the form of ``responses``: a task reads a file record by record.

    ``headers`` are those of the HTTP response, ``payload`` its body as text (by the
    charset of its content type, else UTF-8; bytes that are none become U+FFFD).  Other
    records are passed over.  Paths must be seen by all machines as files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with open(path, "rb") as raw, (gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)) as source:
                    for headers, block in warc_records(source):
                        if headers.get("warc-type") != "response":
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        text = head.decode("latin-1")
                        charset = re.search(r"(?i)^content-type:.*charset=[\"']?([\w-]+)", text, re.M)
                        try:
                            payload = body.decode(charset[1] if charset else "utf-8", "replace")
                        except LookupError:
                            payload = body.decode("utf-8", "replace")
                        rows.append((headers.get("warc-record-id"), headers.get("warc-record-id"), headers.get("warc-target-uri", ""), headers.get("warc-date"), text, payload, headers.get("warc-payload-digest")))
                        if sum(len(r[5]) for r in rows[-64:]) > 1 << 22 or len(rows) == 64:
                            yield record_batch(rows)
                            rows = []
                if rows:
                    yield record_batch(rows)

    def record_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in RESPONSE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, RESPONSE)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Response records of stored pages: id, target, date, headers, payload, and no digest of the source.

    Null urls and payloads count as empty.  The record's id is made from id, url and
    payload, so that only pages which agree in all three share one.
    """
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    size = F.octet_length(html).cast("string")
    return pages.select(
        F.col(id_col).alias("source_id"),
        uuid_of(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, F.md5(html.cast("binary")))).alias("record_id"),
        url.alias("target_uri"),
        (F.lit(None) if date_col is None else F.col(date_col)).cast("string").alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size).alias("headers"),
        html.alias("payload"),
        F.lit(None).cast("string").alias("source_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record, which refer to it.

    Both keep the response's id, target, date, headers and payload digest (the source's
    own where it has one); the metadata block lists the headers, title, language and number
    of links.  Repeated responses give repeated records, empty payloads empty conversions,
    and no rows give none.  A comment, script, style or title without an end reaches to
    that of the page; a page of any length takes time in proportion to it.
    """
    payload = F.col("payload")
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)(?:</title|\z)", 1), r"\s+", " "))
    lang = F.regexp_extract(payload, r"""(?i)<html[^>]*\blang=["']?([A-Za-z-]+)""", 1)
    links = F.size(F.regexp_extract_all(payload, F.lit(r"(?i)(<a\s[^<>]*href=)"), 1)).cast("string")
    metadata = F.concat(F.col("headers"), F.lit("\r\ntitle: "), title, F.lit("\r\nlanguage: "), lang, F.lit("\r\noutlinks: "), links, F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("metadata").alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), tidy(F.col("text")).alias("block")),
    )
    own = F.coalesce("source_digest", digest(payload))
    found = records.select("source_id", "record_id", "target_uri", "date", F.col("headers").alias("source_headers"), own.alias("refers_to_digest"), metadata.alias("metadata"), visible(payload).alias("text"))
    names = found.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t if t is None else decoded(t) for t in batch.column(len(names) - 1).to_pylist()], pa.string())], names)

    rows = map_arrow(found, run, found.schema).select("source_id", "record_id", "target_uri", "date", "source_headers", "refers_to_digest", F.inline(kinds))
    return rows.select(
        "source_id",
        "record_type",
        uuid_of(F.concat_ws("|", "record_type", "record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        F.coalesce("date", F.lit(NO_DATE)).alias("date"),
        "content_type",
        "source_headers",
        "refers_to_digest",
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


def as_warc(records: DataFrame) -> Column:
    """A record in the form of a WARC file, from the columns of ``derivatives``.

    Both records carry the source's headers and payload digest in extension fields; line
    ends within the headers become ``; ``.
    """
    c = F.col
    lines = [
        ("WARC-Type", c("record_type")),
        ("WARC-Record-ID", c("record_id")),
        ("WARC-Date", c("date")),
        ("WARC-Refers-To", c("refers_to")),
        ("WARC-Refers-To-Target-URI", c("target_uri")),
        ("WARC-Refers-To-Date", c("date")),
        ("WARC-Target-URI", c("target_uri")),
        ("WARC-Block-Digest", c("block_digest")),
        ("WARC-Payload-Digest", c("block_digest")),
        ("X-Source-Payload-Digest", c("refers_to_digest")),
        ("X-Source-Headers", F.regexp_replace("source_headers", r"\r?\n", "; ")),
        ("Content-Type", c("content_type")),
        ("Content-Length", c("content_length").cast("string")),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in lines], F.lit("\r\n"), c("block"), F.lit("\r\n\r\n"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.withColumnRenamed("source_id", "page_id")


def _references() -> tuple[str, str]:
    """The named references of HTML 5, and the numbers that don't stand for their own character, as SQL maps from Python's tables."""
    from html.entities import html5

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    codes = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | low for p in range(17) for low in (0xFFFE, 0xFFFF))]
    odd = {n: html.unescape(f"&#{n};") for n in codes if html.unescape(f"&#{n};") != chr(n)}
    chars = lambda t: "".join(f"||chr({ord(c)})" for c in t) if any(ord(c) < 32 for c in t) else "||" + quoted(t)
    named = ", ".join(f"{quoted(k)}: ''{chars(v)}" for k, v in html5.items())
    return f"map {{{named}}}", "map {" + ", ".join(f"{n}: ''{chars(t)}" for n, t in odd.items()) + "}"


def _oracle() -> str:
    uuid = "concat('<urn:uuid:', substr({0},1,8), '-', substr({0},9,4), '-', substr({0},13,4), '-', substr({0},17,4), '-', substr({0},21,12), '>')"
    named, odd = _references()
    crlf = "chr(13) || chr(10)"
    blank = "case when {0} in (chr(9), chr(10), chr(12), chr(13), ' ', chr(160)) then ' ' else {0} end"
    return f"""
with r as (select page_id, md5(concat('response|', coalesce(page_id::varchar, ''), '|', coalesce(url, ''), '|', md5(coalesce(html, '')))) h, coalesce(url, '') target_uri, coalesce(html, '') payload from pages),
s as (select *, {uuid.format("h")} refers_to,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(payload)) source_headers from r),
shown as (select distinct page_id, h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload, '<!--([^-]|-[^-]|--+[^->])*--+>', '', 'g'),
  '(?is)<script[^a-z0-9_].*?</script[ \t\r\n]*>|<style[^a-z0-9_].*?</style[ \t\r\n]*>|<title[^a-z0-9_].*?</title[ \t\r\n]*>', '', 'g'),
  '[ \t\r\n\f\v]+', ' ', 'g'),
  '(?i)</?(?:article|body|div|footer|h[1-6]|header|html|li|nav|ol|p|section|table|tr|ul)(?:[^a-z0-9_>][^>]*)?>|<br */?>', chr(10), 'g') seen from s),
parts as (select page_id, h, unnest(string_split_regex(seen, '<[^>]*>')) part, generate_subscripts(string_split_regex(seen, '<[^>]*>'), 1) nth from shown),
tokens as (select page_id, h, nth, unnest(found) token, generate_subscripts(found, 1) place from (
  select page_id, h, nth, regexp_extract_all(part, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)|[^&]+|&') found from parts)),
known as (select {named} names, {odd} codes),
kinds as (select page_id, h, nth, place, token, names, codes, case when regexp_matches(token, '^&#[0-9]') then 'd' when regexp_matches(token, '^&#[xX][0-9a-fA-F]') then 'x' when length(token) > 1 and token[1] = '&' and token[2] <> '#' then 'n' else '' end kind from tokens, known),
numbers as (select *, ltrim(rtrim(token[case kind when 'x' then 4 else 3 end:], ';'), '0') digits,
  case when kind not in ('d', 'x') then null when digits = '' then 0 when length(digits) > 7 then 1114112 else least(1114112, case kind when 'd' then digits::bigint else concat('0x', digits)::bigint end)::int end code,
  case when kind = 'n' then coalesce(list_max(list_filter(range(2, length(token)), lambda n: names[token[2:n + 1]] is not null)), 0) end held from kinds),
texts as (select page_id, h, nth, place, case
  when kind in ('d', 'x') then {blank.format("(case when codes[code] is not null then codes[code] when code > 1114111 or code between 55296 and 57343 then chr(65533) else chr(code) end)")}
  when kind = 'n' and held > 0 then {blank.format("names[token[2:held + 1]]")} || token[held + 2:]
  else token end piece from numbers),
plain as (select page_id, h, string_agg(piece, '' order by nth, place) body from texts group by 1, 2),
b as (
  select page_id, target_uri, payload, source_headers, refers_to, 'metadata' record_type, 'application/warc-fields' content_type,
    source_headers || {crlf} || 'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))
    || {crlf} || 'language: ' || regexp_extract(payload, '(?i)<html[^>]*\\blang=["'']?([A-Za-z-]+)', 1)
    || {crlf} || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a[ \\t\\r\\n\\f\\v][^<>]*href=')) || {crlf} block from s
  union all
  select s.page_id, target_uri, payload, source_headers, refers_to, 'conversion', 'text/plain',
    trim(regexp_replace(regexp_replace(coalesce(body, ''), '[ \n]*\n[ \n]*', chr(10), 'g'), ' +', ' ', 'g'), concat(' ', chr(10)))
  from s left join plain on s.page_id is not distinct from plain.page_id and s.h = plain.h)
select page_id, record_type, {uuid.format("md5(concat(record_type, '|', refers_to))")} record_id, refers_to, target_uri, '{NO_DATE}' date, content_type, source_headers,
  concat('sha-256:', sha256(payload)) refers_to_digest, concat('sha-256:', sha256(block)) block_digest, octet_length(encode(block))::bigint content_length, block
from b
"""


OP1_SQL = _oracle()
