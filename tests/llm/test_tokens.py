"""Encoding, packing and neighbours against the libraries and brute force."""

from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import ann, bpe, packing


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", " ", "\n\n", "a", "don't STOP 12.5%", "x<|endoftext|>y <|startoftext|>", "é é ΑΣ ΑΣΑ İ ﬁ", "a\xa0b c\x1cd\te\r\nf", "\x00\x01", "日本語 テキスト", "\U0001f600" * 50, "z" * 30_000, "1" * 9_000]


def mixed(rng, n):
    words = ["the", "of", "Of,", "THE...", "don't.", "Ärger!?", "ÿ<|endoftext|>", "a_b", "ab$'s", "İx,", "ΑΣ.", "Straße", "naïve", "…", "don't", "x1y2", "日本", "́", "<|endoftext|>", "A" * 300, "'s", " ", "\x1c"]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "", "\xa0"]) for _ in range(n))


def test_chunks_depend_on_content_alone():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    a, b = (bpe.chunks(start + shared) for start in ("one beginning ", "another ä "))
    assert "".join(a) == "one beginning " + shared and len(set(a) & set(b)) >= len(a) - 3 > 5
    assert bpe.chunks("") == [] and "".join(bpe.chunks("é" * 20_000)) == "é" * 20_000


def test_encoding_equals_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 5)  # many joints
    rng, t, own = random.Random(2), library(bpe.TOKENIZER), bpe.Coder()
    shared = mixed(rng, 300)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 100_000)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 100)
    texts = [*ODD, *(mixed(rng, n) for n in range(1, 120)), *(mixed(rng, 5) + shared for _ in range(20))]
    for at in range(0, len(texts), 10):
        some = texts[at : at + 10]
        found = own.encode_all(some)
        want = [t.encode(x, add_special_tokens=False).ids for x in some]
        assert found.to_pylist() == want
        assert own.decode(found).to_pylist() == [t.decode(ids, skip_special_tokens=False) for ids in want]
    assert own.reused > 100 and own.repaired > 100 and own.whole == 0


class Merging(bpe.Coder):
    """A coder whose tokenizer takes some words together across a blank: "foo bar" becomes one word."""

    def ids_of(self, words):
        return self.batch([" ".join(words)])[0]

    def batch(self, texts):
        flat = [" ".join(filter(None, bpe.BLANK.split(t))) for t in texts]
        return super().batch([t.replace("foo bar", "zebra") for t in flat])


def test_words_of_one_byte_characters_equal_the_library():
    """All pairs of these characters, at the beginning, in the middle and at the end of a word."""
    own, t = bpe.Coder(), library(bpe.TOKENIZER)
    signs = [chr(c) for c in range(1, 256)]
    texts = [" ".join(f"{a}{b} x{a}{b} {a}{b}x x{a}{b}y" for b in signs) for a in signs]
    got = own.encode_all(texts).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        assert ids == t.encode(text, add_special_tokens=False).ids, repr(text[:3])


def test_joints_that_disagree_grow(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 5)
    rng, own = random.Random(3), Merging()
    words = ["foo", "bar", "foo bar", "six", "abcdefghijklmnop", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(60)]
    assert own.encode_all(texts).to_pylist() == [np.frombuffer(i, np.int32).tolist() for i in own.batch(texts)]
    assert own.grown > 20 and own.whole < own.grown / 2


def test_each_chunk_is_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 5)
    rng, own = random.Random(4), bpe.Coder()
    shared = mixed(rng, 400)
    texts = [f"{mixed(rng, 3)} {shared}" for _ in range(30)]
    own.encode_all(texts[:10])
    own.encode_all(texts[10:])
    parts = [c for t in texts for c in bpe.chunks(t) if bpe.BLANK.search(c)]
    assert own.encoded == len(set(parts)) and own.reused == len(parts) - len(set(parts)) > 10 * own.encoded
    assert own.grown == 0 < own.repaired


def test_encoding_of_rows(spark):
    rows = [*enumerate(ODD), (3, "a"), (3, "a"), (None, None), (99, None), *((200 + i, "hot text again") for i in range(50))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    t = library(bpe.TOKENIZER)
    got = sorted((str(r[0]), r[1]) for r in bpe.encode(frame).collect())
    assert got == sorted((str(i), t.encode(x or "", add_special_tokens=False).ids) for i, x in rows)
    assert bpe.encode(frame.limit(0)).count() == 0


def test_ids_equal_the_library_over_all_code_points():
    t = library(f"{packing.TOKENIZER}.json")
    step = 1 if os.environ.get("TEST_ALL_CODE_POINTS") else 23
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}  {chr(c)}A.'s" for c in range(0, 0x110000, step) if not 0xD800 <= c <= 0xDFFF]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.ids_of(text).tolist() == [*e.ids, 0], text


def test_hilbert_visits_neighbours():
    for dims, depth in ((2, 3), (3, 2), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << depth)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert(grid, depth)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_lay():
    rng = random.Random(4)
    for sizes in ([], [1], [8], [3, 5], [7, 2, 30], [rng.randrange(1, 40) for _ in range(50)]):
        docs = [(i, np.arange(n)) for i, n in enumerate(sizes)]
        check_pieces([(d, s, len(i), n, q, o) for d, s, i, n, q, o in packing.lay(iter(docs), 8)], dict(enumerate(sizes)), 8, [i.tolist() == list(range(s, s + len(i))) for _, s, i, _, _, _ in packing.lay(iter(docs), 8)])


def check_pieces(pieces, sizes, size, same):
    assert all(same)
    at, sequences = defaultdict(int), defaultdict(list)
    for doc, start, length, total, sequence, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == at[doc] and length > 0 and total == sizes[doc]
        at[doc] += length
        sequences[sequence].append((offset, length))
    assert dict(at) == sizes
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size and end & (end - 1) == 0  # nothing is padded


def test_packing(spark):
    rows = [*enumerate(ODD), (50, None), *((100 + i, f"the same text {i // 40}") for i in range(90))]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    t = library(f"{packing.TOKENIZER}.json")
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    found = packing.with_digest(packing.packed(frame, size=64)).collect()
    same = [r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in found]
    check_pieces([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in found], {i: len(x) for i, x in ids.items()}, 64, same)
    assert packing.packed(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "z"), (1, "z")], "doc_id long, text string")
    assert sum(r["length"] for r in packing.packed(odd).collect()) == 2 * len(packing.ids_of("x y")) + 2 * len(packing.ids_of("z"))
    with pytest.raises(ValueError):
        packing.packed(frame, size=100)


def test_equal_rows_are_dealt_to_several_tasks(spark):
    for doc in (None, 7):
        rows = spark.range(6000, numPartitions=6).select(F.lit(doc).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
        found = packing.packed(rows, parts=8).select((F.col("sequence_id") / (1 << 40)).cast("int").alias("part"), "length").groupBy("part").agg(F.sum("length").alias("n")).collect()
        total = sum(r["n"] for r in found)
        assert total == 6000 * len(packing.ids_of("the same words")) and max(r["n"] for r in found) <= total / 3


def test_neighbours_lie_together(spark):
    rng = random.Random(5)
    kinds = {0: "the of and to in is that with".split(), 1: "der die das und von mit ein zu".split()}
    frame = spark.createDataFrame([(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(200)], "doc_id long, text string")
    found = packing.packed(frame, size=256, parts=1).orderBy("sequence_id", "offset").collect()
    order = [r["doc_id"] % 2 for r in found if r["start"] == 0]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) < 60  # 100 by chance


def brute_nearest(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, (i, a) in enumerate(ok):
        if i % 10 == 0:
            scores = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j) for x, (j, b) in enumerate(ok) if x != q and len(b) == len(a))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).astype("f4").tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # one vector many times
    rows += [(500 + i, [-x for x in rows[3][1]]) for i in range(3)]
    rows += [(600, None), (610, [0.0] * 16), (620, [1.0] * 15 + [None]), (630, [float("nan")] * 16), (640, [float("inf")] * 16), (650, [1.0, 2.0, 3.0, 4.0]), (None, rows[5][1])]
    rows += [(660 + i, rng.standard_normal(4).astype("f4").tolist()) for i in range(12)] + [(700, [1.0] * 70), (701, [1.0] * 69 + [2.0])]
    frame = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(frame, "id % 10 = 0").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_nearest(rows)
    assert got.keys() == {q for q, w in want.items() if w} and {650, 660, 700} <= got.keys()
    found = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert found >= 0.98 * sum(map(len, want.values()))
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True) if a[0] == b[0])
    assert [j for j, _ in got[400]] == [3, 401, 402, 403, 404]
    assert ann.nearest(frame.limit(0), "id % 10 = 0").count() == 0
    assert sorted(r["vec_id"] for r in ann.nearest(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<double>"), "id = 0").collect()) == [1, 2]


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got, exact = (defaultdict(set), defaultdict(set))
    for margin, into in ((ann.MARGIN, got), (float("inf"), exact)):
        for r in ann.nearest(frame, "id % 50 = 0", margin=margin).collect():
            into[r["query_id"]].add(r["vec_id"])
    hits = n = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        score[i] = -2
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hits, n = hits + len(best & got[ids[i]]), n + 5
        assert len(best & exact[ids[i]]) == 5
    assert hits >= 0.98 * n


def test_error_bounds_hold():
    rng = np.random.default_rng(7)
    unit = rng.standard_normal((3000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, fit = ann.codes_of(unit, turn)
    assert code.dtype == np.uint64 and code.shape == (3000, 1)
    signs = np.where(unit @ turn > 0, 1.0, -1.0)
    about, error = ann.estimates(unit[:50] @ turn, code, fit)
    assert np.abs(about - (unit[:50] @ turn) @ signs.T / (8 * fit)).max() < 0.1  # the planes give the inner product, but for the rounding
    inside = np.abs(about - unit[:50] @ unit.T) <= error
    assert inside.mean() > 0.97 and np.abs(about - unit[:50] @ unit.T).mean() < 0.12


def test_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(frame, "id % 10 = 0").collect()))
    monkeypatch.setattr(ann, "DATA_BYTES", 30 * 8 * 16)
    monkeypatch.setattr(ann, "LEAST_BYTES", 8 * 16)
    monkeypatch.setattr(ann, "QUERY_BYTES", 7 * 8 * 16)
    again = sorted(map(tuple, ann.nearest(frame, "id % 10 = 0").collect()))
    assert len(again) == 100 and len(set(whole) & set(again)) >= 98
