"""Exact and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import exact_dedup, simhash
from rowloom.llm.components import components
from rowloom.llm.common import join_on_unique, only_rows, row_key


def brute_exact(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(body(text), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for i, (doc, text) in enumerate(rows):
        first = min(groups[body(text)])
        out.append((doc, rows[first[3]][0], len(groups[body(text)]), hashlib.sha256(body(text).encode()).hexdigest()))
    return out


def exact_rows(rng):
    texts = ["", None, " \n", "a b", "ab", "a\tb\x0b", "a\xa0b", " ab", "x" * 200_000, "ä ö", "äö"]
    return [(i, rng.choice(texts)) for i in range(60)] + [(i, "hot text") for i in range(100, 160)] + [(5, "ab"), (5, "ab"), (None, "ab"), (None, None)]


def test_exact_equals_brute_force(spark):
    rows = exact_rows(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, keep_id string, kept boolean").repartition(5)
    for hash_of in (exact_dedup.content_hash, lambda text: F.unhex(F.substring(F.md5(text.cast("binary")), 1, 1 + 1))):  # the second one clashes
        got = exact_dedup.exact_duplicates(docs, hash_of=hash_of).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r[:3]) + (r["text_sha256"],) for r in got), key=key) == sorted(brute_exact(rows), key=key)
        assert sum(r["kept"] for r in got) == len({x[3] for x in brute_exact(rows)})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({x[3] for x in brute_exact(rows)})
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_clashing_hashes_are_told_apart(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, hash_of=lambda text: F.lit(b"same")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(i, i % 7) for i in range(50)}


def reference_print(text, words=4):
    import xxhash

    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + words]).encode(), seed=42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", " \n", None, "one", "One two", "É é e", "a\xa0b c\x1cd e f", *(" ".join(rng.choice("the of And X ß 1".split()) for _ in range(n)) for n in (3, 4, 5, 40, 400))]
    assert [simhash.fingerprint(t) for t in texts] == [reference_print(t) for t in texts]
    assert simhash.fingerprint("a " * 70_000) == reference_print("a " * 70_000)


def near_texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for size in (1, 2, 3, 30, 80):
        base = [word() for _ in range(400)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(400)] = word()
            out.append(" ".join(own))
    return out + ["", None, "  ", "b a"] + [out[0]] * 3


def brute_components(ids, prints, distance):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    known = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            known[r] = min(known.get(r, ids[i]), ids[i])
    return [known.get(r) for r in root]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts(random.Random(3))
    ids = [*range(1000, 1000 + len(texts) - 1), None]
    prints = [reference_print(t) for t in texts]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, fingerprint string").repartition(4)
    for distance in (0, 4, 9):
        got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, distance=distance).collect()}
        assert got == {(i, format(p, "016x"), c) for i, p, c in zip(ids, prints, brute_components(ids, prints, distance), strict=True)}
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(ids, prints, 4)))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_buckets_above_a_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 62)
    prints = np.array([int(center) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)], np.uint64)
    prints = np.unique(np.concatenate((prints, rng.integers(0, 1 << 63, 50).astype(np.uint64))))
    distinct = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    for parts in simhash.plan(prints, len(prints), 4), simhash.plan(prints, 10**9, 4), [(list(range(32)), 2), (list(range(32, 64)), 1)]:
        edges = simhash.links(simhash.in_blocks(simhash.keyed(distinct, parts), parts, 4), 4)
        got = {r[0]: r[1] for r in components(edges).collect()}
        unsigned = [int(p) for p in prints]
        want = brute_components([int(p) for p in prints.view(np.int64)], unsigned, 4)
        assert [got.get(int(p), int(p)) for p in prints.view(np.int64)] == want


def test_thresholds_follow_the_pigeonhole_principle():
    rng = np.random.default_rng(5)
    sample = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    for n in (10, 10**5, 10**8, 10**10):
        for m in range(1, 7):
            groups = simhash.group_bits(sample, m)
            assert sorted(b for g in groups for b in g) == list(range(64))
            assert sum(t + 1 for t in simhash.allocate(sample, groups, n, 4)[1]) == 5
    assert simhash.plan(sample[:0], 0, 4)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (2000, 64), dtype=np.uint8)
    for b in range(1, 16):
        bits[:, 4 * b] = bits[:, 0]
    sample = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    groups = simhash.group_bits(sample, 4)
    assert [4 * b for b in range(16)] in groups


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (-3, 4), (None, 4), (4, None)]
    root = {n: n for e in edges for n in e if None not in e}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = root[a], root[b]
            root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == r for n, r in root.items()) and set(got) <= set(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_of_heavy_keys(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 2000, 2)] + [(1, 10)], "k long, w long")
    for how, plain in (("inner", 0), ("left", 0), ("left", 10**6)):
        assert sorted(map(str, join_on_unique(left, right, ["k"], how, plain=plain).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_repeated_rows_collapse_before_the_shuffle(spark, capsys):
    rows = spark.range(100_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    keys = rows.limit(1).select(row_key("doc_id", "text").alias("row_key"))
    kept = only_rows(rows, keys, "doc_id", "text")
    kept.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("partial_first") == 1 and plan.count("Exchange hashpartitioning(row_key") <= 2
    assert kept.collect() == [(None, "again")]
