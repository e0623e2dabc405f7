"""WARC derivatives against SQL, the stages of the pipeline against brute force, and the queries' registration."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import exact_dedup, packing, pii, queries, simhash, toxicity, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for table in os.listdir(FOLDER):
        duck.sql(f"create view {table.split('.')[0]} as from '{FOLDER}/{table}'")
    queries.QUERIES[name](spark, FOLDER).write.parquet(f"{tmp_path}/out")
    got, want = duck.sql(f"from '{tmp_path}/out/*.parquet'"), duck.sql(queries.ORACLES[name])
    columns = ",".join(sorted(got.columns))
    assert sorted(zip(got.columns, map(str, got.types), strict=True)) == sorted(zip(want.columns, map(str, want.types), strict=True))
    assert sorted(map(repr, got.project(columns).fetchall())) == sorted(map(repr, want.project(columns).fetchall()))


def test_registration():
    assert [f"op{n}" for n in range(1, 11)] == sorted((q.split("_")[0] for q in queries.QUERIES), key=lambda q: int(q[2:]))


def test_warc_records(spark):
    html = "<html lang=en><head><title>A &amp;\nB</title><style>x</style></head><body><h1>Hi</h1><!-- no <p> --><p>one  two<br>three &lt;3 &amp;amp;</p><script>var a='<p>';</script><a href='x'>l</a></body></html>"
    rows = [(1, "http://a/", html), (2, None, None), (3, "http://c/", ""), (1, "http://a/", html), (None, "u", "plain")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    found = warc.derivatives(warc.responses(pages))
    assert set(found.columns) >= {"source_headers", "date", "refers_to_digest"}
    got = found.select("*", warc.as_warc(found).alias("warc")).collect()
    assert len(got) == 10 and len({r["record_id"] for r in got}) == 8
    one = {r["record_type"]: r for r in got if r["source_id"] == 1}
    assert one["conversion"]["block"] == "Hi\none two\nthree <3 &amp;\nl"
    assert "title: A &amp; B\r\nlanguage: en\r\noutlinks: 1" in one["metadata"]["block"] and "Content-Length: " in one["metadata"]["block"]
    assert one["conversion"]["refers_to"] == one["metadata"]["refers_to"] and one["conversion"]["refers_to_digest"] == one["metadata"]["refers_to_digest"]
    assert one["conversion"]["warc"].startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and f"WARC-Refers-To: {one['conversion']['refers_to']}" in one["conversion"]["warc"]
    assert {r["block"] for r in got if r["source_id"] in (2, 3) and r["record_type"] == "conversion"} == {""}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append((name, docs, out))
        docs = out
    assert [k[0] for k in kept] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    assert all(out.columns == columns for _, _, out in kept[:-1])
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    _, before, after = kept[0]
    model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if model.score(r["text"]) < 0.5)
    assert len(ids(after)) > 0.8 * before.count()

    _, before, after = kept[1]
    first = {}
    for r in sorted(before.collect(), key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        body = (r["text"] or "").translate(dict.fromkeys(map(ord, exact_dedup.BLANKS)))
        first.setdefault(body, r["doc_id"])
    assert ids(after) == sorted(first.values())

    _, before, after = kept[2]
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"])) for r in before.collect())
    root = {i: i for i, _ in rows}
    for i, p in rows:
        for j, q in rows:
            if j < i and (p ^ q).bit_count() <= 4:
                a, b = root[i], root[j]
                root = {n: min(a, b) if r in (a, b) else r for n, r in root.items()}
    assert ids(after) == sorted(set(root.values()))

    _, before, after = kept[3]
    assert ids(after) == ids(before)
    texts = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        base = [{"kind": k, "start": s, "end": e} for k, s, e in pii.base_spans(r["text"])]
        masked = texts[r["doc_id"]]
        assert not pii.base_spans(masked["text"]) and masked["n_chars"] == len(masked["text"])
        assert base or not r["text"] or masked["text"] == r["text"] or "[" in masked["text"]

    _, before, after = kept[4]
    sizes = {r["doc_id"]: len(packing.ids_of(r["text"])) for r in before.collect()}
    assert {r[0]: r[1] for r in after.groupBy("doc_id").agg(F.sum("length")).collect()} == sizes
    whole = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    assert {r[0]: r[1] for r in whole} == {r[0]: r[2] for r in whole} == sizes


def test_masking_keeps_rows(spark):
    rows = [(1, "mail a@b.cd now"), (1, "mail a@b.cd now"), (None, "ip 1.2.3.4"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_chars int, spans string")
    got = pii.without_personal_data(docs, chars_col="n_chars")
    assert got.columns == docs.columns
    assert sorted(str(r["text"]) for r in got.collect()) == ["", "None", "ip [IP]", "mail [EMAIL] now", "mail [EMAIL] now"]
    assert sorted(r["n_chars"] for r in got.collect()) == [0, 0, 7, 16, 16]


CLASH = ["_row_key", "row_key", "doc", "spans", "row", "id", "key", "part", "score", "toxic", "fp", "seen"]


def test_stages_with_odd_rows(spark):
    """Empty tables, nulls in any column, repeated rows, a long text, and extra columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    rows = docs.limit(20).collect()
    odd = [(None, None, None, None, None, *[None] * len(CLASH))] * 3 + [(7, None, "en", None, None, *["x"] * len(CLASH)), (None, "", None, "s", 0, *["y"] * len(CLASH)), (900, "word " * 60_000, "en", "s", 1, *["z"] * len(CLASH))]
    frame = spark.createDataFrame([*map(tuple, rows), *map(tuple, rows[:3]), *odd], docs.schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        for some in (frame, frame.limit(0)):
            out = stage(spark, some, FOLDER)
            found = out.collect()
            if name == "packing":
                assert (sum(r["length"] for r in found) > 60_000) == bool(some.count())
                continue
            assert out.columns == docs.columns and (found or not some.count())
            for r in found:
                if r["doc_id"] is not None and r["_row_key"] not in ("x", "z"):
                    assert [r[c] for c in CLASH] == [f"{c}{r['doc_id']}" for c in CLASH]
            if name in ("toxicity", "pii"):
                assert len(found) <= some.count() and (name == "toxicity" or len(found) == some.count())
            elif some.count():
                assert sum(r["text"] is None or not r["text"].strip() for r in found) == 1  # nulls and blanks are one class
