"""The plain text of pages against the references of HTML 5 and against Python's own decoder."""

import gzip
import hashlib
import html
import io
import random
import re
from html.entities import html5

from rowloom.llm import warc

BLANKS = " \t\n\f\r\xa0"


def test_conversion_decodes_all_references(spark):
    names = sorted(n for n in html5 if n.endswith(";"))
    numbers = [*range(1, 0x300), 0x2019, 0xD800, 0xFFFD, 0x1F600, 0x10FFFF, 0x110000]
    references = [f"&{n}" for n in names] + [f"&#{n};" for n in numbers] + [f"&#x{n:x};" for n in numbers] + [f"&#X{n:05X};" for n in numbers]
    pages = [(i, "u", f"<p>a{r}b</p>") for i, r in enumerate(references)]
    pages.append((-1, "u", "<footer>&copy; x &middot; It&#8217;s caf&#xE9; &amp;copy; &am<b>p;</b> &not<i>in;</i> AT&ampT &copy</footer>"))
    rows = warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).where("record_type = 'conversion'").collect()
    got = {r["source_id"]: r for r in rows}
    assert got[-1]["block"] == "© x · It’s café &copy; &amp; ¬in; AT&T ©"
    for i, r in enumerate(references):
        char = html.unescape(r)
        assert got[i]["block"] == f"a{' ' if char in BLANKS and char else char}b", r
        assert got[i]["content_length"] == len(got[i]["block"].encode())


def test_decoder_equals_pythons_by_brute_force():
    rng = random.Random(5)
    pieces = ["&", "#", "x", "X", ";", "copy", "amp", "nbsp", "am", "lt", "160", "0", "9", "A0", "38", "8217", " ", "\n", "é", "Tab", "notit", "\U0001f600"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        flat = lambda t: re.sub(r"[ \t\n\f\r\xa0]", " ", t)
        assert flat(warc.decoded(text)) == flat(html.unescape(text)), text


def test_unclosed_parts_end_with_the_page(spark):
    long = {1: "<!--" * 100_000, 2: "<script " * 50_000, 3: "<p>" * 100_000, 4: "<a " * 100_000, 5: "&" * 200_000, 6: "<title>" * 50_000}
    texts = {10: "a<!-- b <p>c", 11: "a<script>var x", 12: "<title>t<p>u", 13: "a<b", 14: "<STYLE>x</Style >y<!-- - -- --->z", 15: "<head>h<p>i"}
    pages = spark.createDataFrame([(i, "u", t) for i, t in (long | texts).items()], "page_id long, url string, html string")
    rows = {r["source_id"]: r["block"] for r in warc.derivatives(warc.responses(pages)).where("record_type = 'conversion'").collect()}
    assert [rows[i] for i in texts] == ["a", "a", "", "a<b", "yz", "h\ni"]
    assert rows[1] == rows[2] == rows[3] == rows[6] == "" and rows[5] == long[5]


def test_pages_that_differ_have_different_ids(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (None, "u", "a"), (None, "u", "b"), (1, "u", "a")], "page_id long, url string, html string")
    assert len({r[0] for r in warc.responses(pages).select("record_id").collect()}) == 4


def test_records_of_warc_files(spark, tmp_path):
    body = "<html lang=fr><p>caf\xe9</p></html>"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nServer: x"
    block = (head + "\r\n\r\n" + body).encode("latin-1")
    record = lambda kind, i, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Payload-Digest: sha1:{i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    data = record("warcinfo", 0, b"x") + b"".join(record("response", i, block) for i in range(1, 100)) + record("request", 100, b"GET /")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record("response", i, block)) for i in (200, 201)))
    found = warc.derivatives(warc.read_responses(spark, [f"{tmp_path}/a.warc", f"{tmp_path}/b.warc.gz"]))
    rows = found.select("*", warc.as_warc(found).alias("warc")).collect()
    assert len(rows) == 202 and {r["block"] for r in rows if r["record_type"] == "conversion"} == {"caf\xe9"}
    one = next(r for r in rows if r["refers_to"] == "<urn:uuid:200>" and r["record_type"] == "conversion")
    assert (one["target_uri"], one["date"], one["refers_to_digest"], one["source_headers"]) == ("http://h/200", "2024-01-02T03:04:05Z", "sha1:200", head)
    written = list(warc.warc_records(io.BytesIO("".join(r["warc"] for r in rows).encode())))
    assert len(written) == 202
    for headers, block_ in written:
        assert headers["warc-block-digest"] == "sha-256:" + hashlib.sha256(block_).hexdigest() and headers["warc-date"] == "2024-01-02T03:04:05Z"
        assert headers["x-source-headers"] == head.replace("\r\n", "; ") and headers["x-source-payload-digest"].startswith("sha1:") and headers["warc-refers-to"].startswith("<urn:uuid:")
    for cut in (50, len(record("warcinfo", 0, b"x")) + 400):
        try:
            list(warc.warc_records(io.BytesIO(data[:cut])))
            raise AssertionError
        except ValueError:
            pass
    assert warc.read_responses(spark, []).count() == 0
