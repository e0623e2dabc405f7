"""Packing along a space-filling curve.

A document's token ids are hashed to a vector, the vector is projected to few dimensions
and its place on a Hilbert curve is the document's key.  Documents are range-partitioned
and sorted by key; neighbours on the curve are laid end to end and the row of tokens is
cut into sequences.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SEQUENCE = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Hashed dimensions, dimensions of the curve, and bits of each.
HASHED, DIMS, DEPTH = 64, 3, 10
#: Documents of each range, and at most in all, from which the bounds are taken; they decide how even the tasks are, not what is packed.
BOUND_DOCS, MOST_BOUND_DOCS = 100, 100_000
#: Bits of the key below the curve's, filled from a hash of the row and its input partition, so that equal documents, even equal rows, can be dealt to several tasks.
TIE_BITS = 32


def encoder(name: str = TOKENIZER):
    """The vocabulary as a tiktoken encoding; its special token is encoded where its text stands.

    It gives the ids of the tokenizers library for the JSON file of the same name, which
    the tests compare over all of Unicode, several times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


_encoders: dict[str, object] = {}


def ids_of(text: str | None, name: str = TOKENIZER, end_id: int = END_ID) -> np.ndarray:
    """A document's ids with the closing one, as unsigned 32-bit numbers; null counts as empty."""
    own = _encoders.get(name)
    if own is None:
        own = _encoders[name] = encoder(name)
    ids = own.encode_to_numpy(text, allowed_special="all") if text else ()
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, end_id
    return out


def hilbert(coordinates: np.ndarray, depth: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of ``depth``-bit coordinates (Skilling's transform, over all rows at once)."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:
        below = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (depth - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """From token ids to keys on the curve; the same for all tasks, as its tables come from a fixed seed."""

    def __init__(self, vocabulary: int = 1 << 16, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.place = rng.integers(0, HASHED, vocabulary)
        self.sign = rng.choice((-1.0, 1.0), vocabulary)
        self.project = np.linalg.qr(rng.standard_normal((HASHED, HASHED)))[0][:, :DIMS]

    def vector(self, ids: np.ndarray) -> np.ndarray:
        at = ids % len(self.place)
        v = np.bincount(self.place[at], self.sign[at], HASHED)
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Projected coordinates have a spread of 1 / sqrt(HASHED); they are levelled by a logistic curve before rounding."""
        flat = 1 / (1 + np.exp(-1.7 * np.sqrt(HASHED) * (vectors @ self.project)))
        return hilbert(np.clip((flat * (1 << DEPTH)).astype(np.int64), 0, (1 << DEPTH) - 1), DEPTH)


_curve: Curve | None = None


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, bounds: list[int]) -> DataFrame:
    """``(id, part, key, ids)``; ``ids`` are 16-bit where they fit, and ``part`` is the range that holds ``key``."""
    kind, edges = docs.schema[id_col].dataType.simpleString(), np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _curve
        _curve = _curve or Curve()
        for batch in batches:
            for part in slices(batch):
                ids = [ids_of(t, tokenizer) for t in part.column(1).to_pylist()]
                key = (_curve.keys(np.array([_curve.vector(i) for i in ids])) << TIE_BITS) | part.column(2).to_numpy()
                wide = [bool(i.max() > 0xFFFF) for i in ids]
                data = [i.tobytes() if w else i.astype("<u2").tobytes() for i, w in zip(ids, wide, strict=True)]
                at = np.searchsorted(edges, key, "right").astype(np.int32)
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "part": pa.array(at), "key": pa.array(key), "wide": wide, "ids": pa.array(data, pa.binary())})

    tie = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id(), F.lit(8)), F.lit(1 << TIE_BITS))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tie.alias("tie")).mapInArrow(run, f"id {kind}, part int, key long, wide boolean, ids binary")


def range_bounds(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, parts: int) -> list[int]:
    """Keys that split a bounded sample of documents into ``parts`` ranges of like token counts."""
    n, most = docs.count(), min(BOUND_DOCS * parts, MOST_BOUND_DOCS)
    some = docs.where(F.rand(9) * max(n, 1) < most)  # by chance, not by id: ids can be null or all alike
    sizes = encoded(some, id_col, text_col, tokenizer, []).select("key", F.length("ids").alias("n"))
    rows = sizes.limit(2 * most).toArrow()  # the limit gathers keys and lengths, not texts
    if not rows.num_rows:
        return []
    keys, sizes = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(keys)
    filled = np.cumsum(sizes[order], dtype=np.int64)
    return keys[order][np.searchsorted(filled, filled[-1] * np.arange(1, parts) / parts)].tolist()


def lay(rows: Iterator[tuple[object, np.ndarray]], size: int) -> Iterator[tuple[object, int, np.ndarray, int, int, int]]:
    """``(id, start, ids, doc_tokens, sequence, offset)`` of pieces: documents end to end, cut every ``size`` tokens.

    What is left at the end is cut into sequences whose lengths are powers of two, so
    that nothing is padded.
    """
    held, used, sequence = [], 0, 0
    for doc, ids in rows:
        start = 0
        while start < len(ids):
            take = min(size - used, len(ids) - start)
            held.append((doc, start, ids[start : start + take], len(ids)))
            start, used = start + take, used + take
            if used == size:
                at = 0
                for d, s, i, n in held:
                    yield d, s, i, n, sequence, at
                    at += len(i)
                held, used, sequence = [], 0, sequence + 1
    room, at = (1 << used.bit_length() - 1 if used else 0), 0
    for d, s, i, n in held:
        done = 0
        while done < len(i):
            take = min(room - at, len(i) - done)
            yield d, s + done, i[done : done + take], n, sequence, at
            done, at, used = done + take, at + take, used - take
            if at == room:
                room, at, sequence = (1 << used.bit_length() - 1 if used else 0), 0, sequence + 1


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SEQUENCE, parts: int | None = None) -> DataFrame:
    """Pieces of all documents: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers.  Every token lies in exactly one
    piece; sequences have ``size`` tokens, and the rest of each of the ``parts`` ranges
    fills sequences of powers of two.  Null texts count as empty and give the closing id;
    repeated rows and null ids are packed as rows of their own; long texts span
    sequences; other columns are ignored; an empty table gives an empty result.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, id_col, text_col, tokenizer, parts)
    dealt = encoded(docs, id_col, text_col, tokenizer, bounds).repartitionById(parts, F.col("part")).sortWithinPartitions("key", "id")
    schema = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] = []

        def rows() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                for some in slices(batch):
                    first.extend(some.column(1).to_pylist()[:1])
                    for doc, wide, data in zip(some.column(0), some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True):
                        yield doc, np.frombuffer(data, "<u4" if wide else "<u2")

        out: list[tuple] = []
        held = 0
        for piece in lay(rows(), size):
            out.append(piece)
            held += len(piece[2])
            if held > 1 << 20:
                yield batch_of(out, first[0])
                out, held = [], 0
        if out:
            yield batch_of(out, first[0])

    def batch_of(pieces: list[tuple], part: int) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*pieces, strict=True)
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array([d.as_py() for d in doc], doc[0].type), "start": pa.array(start, pa.int64()), "length": pa.array([len(i) for i in ids], pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
                "sequence_id": pa.array([(part << 40) + s for s in sequence], pa.int64()), "offset": pa.array(offset, pa.int64()), "ids": pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
            }
        )

    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_digest(pieces: DataFrame) -> DataFrame:
    ids: Column = F.crc32("ids")
    return pieces.withColumn("ids_crc32", ids).drop("ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_digest(packed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
