"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits of each other link; linked ones, directly or through
others, form a component.  The 64 bits are dealt into partitions of correlated bits.  If
the thresholds t_i of m partitions add up to distance - m + 1, two linked fingerprints
differ in at most t_i bits of some partition i (-1: that partition is skipped).  Dynamic
programming picks the thresholds that cost least, by the numbers of candidates that a
bounded sample of fingerprints predicts; all fingerprints are then probed and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_on_unique, map_arrow, only_rows, row_key, sorted_groups, table
from .components import components

BITS = 64
#: Fingerprints in a block of candidates; larger buckets become pairs of blocks.
BLOCK = 2048
#: Fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 2048
#: Costs of the plan, in seconds: a row that is shuffled, and a candidate pair that is verified.
ROW_COST, PAIR_COST = 2e-6, 4e-9


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles (XXH64, seed 42), as an unsigned number.

    A-Z are lower-cased and words lie between ASCII blanks.  With fewer words than a
    shingle has, the whole sequence is the one shingle; no words give 0.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, k = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - k + 1].tolist()
    stops, of, total = ends[k - 1 :].tolist(), xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.array([of(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, row_key, fp)``; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return {"id": batch.column(0), "row_key": batch.column(2), "fp": pa.array(fp.view(np.int64))}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    return map_arrow(rows, run, f"id {kind}, row_key string, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of near-equal size, correlated bits together."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    ones = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    ones -= ones.mean(0)
    spread = np.sqrt((ones**2).sum(0))
    alike = np.abs(ones.T @ ones) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(alike, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - i)
        own = [max(sorted(free), key=lambda b: alike[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < size:
            own.append(max(sorted(free), key=lambda b: alike[b, own].sum()))
            free.discard(own[-1])
        groups.append(sorted(own))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def probes(width: int, threshold: int) -> int:
    return sum(comb(width, t) for t in range(1, threshold + 1))


def allocate(sample: np.ndarray, groups: list[list[int]], n: int, distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds of ``groups`` for ``n`` fingerprints, and their cost in seconds."""
    pairs, apart = max(1, len(sample) * (len(sample) - 1) // 2), sample[:, None] ^ sample[None, :]
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        near = np.bincount(np.bitwise_count(apart & np.uint64(mask_of(bits))).ravel(), minlength=BITS + 1)
        near[0] -= len(sample)
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance + 1 - spent):
                even = sum(comb(len(bits), j) for j in range(t + 1)) / 2.0 ** len(bits)
                share = max(near[: t + 1].sum() / 2 / pairs, even)
                own = 0.0 if t < 0 else n * (1 + probes(len(bits), t)) * ROW_COST + share * n * n / 2 * PAIR_COST
                if (now := spent + t + 1) not in grown or cost + own < grown[now][0]:
                    grown[now] = (cost + own, [*chosen, t])
        best = grown
    return best[distance + 1]


def plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each partition that is probed."""
    most = min(distance + 2, BITS)
    options = [(*allocate(sample, groups := group_bits(sample, m), n, distance), groups) for m in range(1, most + 1)]
    _, thresholds, groups = min(options, key=lambda o: o[0])
    return [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]


def keyed(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``(part, key, fp, probe)``: each fingerprint under its own key and, as a probe, under the keys nearby."""

    flips = [[sum(1 << b for b in some) for t in range(1, threshold + 1) for some in combinations(bits, t)] for bits, threshold in parts]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for i, (bits, _) in enumerate(parts):
            own = fp & np.uint64(mask_of(bits))
            for at, flip in enumerate([0, *flips[i]]):
                yield {"part": np.full(len(fp), i, np.int32), "key": (own ^ np.uint64(flip)).view(np.int64), "fp": fp.view(np.int64), "probe": np.full(len(fp), at > 0)}

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(batch):
                yield pa.RecordBatch.from_pydict(out)

    return distinct.select("fp").mapInArrow(all_of, "part int, key long, fp long, probe boolean")


def links_within(fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what lies within ``distance`` in one block: a spanning forest, not all pairs.

    Two probes of a bucket need not be compared, as one of them meets the other's own key.
    """
    a, b = [], []
    open_ = np.ones(len(fp), bool)
    for root in range(len(fp)):
        if not open_[root]:
            continue
        open_[root], front = False, [root]
        while front:
            some, front = front[:256], front[256:]
            left = np.flatnonzero(open_)
            if not len(left):
                break
            near = np.bitwise_count(fp[some, None] ^ fp[None, left]) <= distance
            near &= ~(probe[some, None] & probe[None, left])
            hit = np.flatnonzero(near.any(0))
            if len(hit):
                found = left[hit]
                open_[found] = False
                a.append(fp[found])
                b.append(fp[np.asarray(some)[near[:, hit].argmax(0)]])
                front += found.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(rows: DataFrame, distance: int) -> DataFrame:
    """``edges(a, b)`` from keyed rows that carry ``block``: verified links that connect each block."""
    keys = ["part", "key", "turn", "rest", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            fp, probe = group["fp"].view(np.uint64), group["probe"].astype(bool)
            change = np.zeros(len(fp), bool)
            for k in keys:
                change[1:] |= group[k][1:] != group[k][:-1]
            number = np.cumsum(change)
            sizes = np.bincount(number)
            a, b, small = [], [], sizes[number] <= 48
            x, p, g = fp[small], probe[small], number[small]
            for lag in range(1, 48):  # all pairs of small groups at once
                if not (same := g[lag:] == g[:-lag]).any():
                    break
                same &= ~(p[lag:] & p[:-lag]) & (np.bitwise_count(x[lag:] ^ x[:-lag]) <= distance)
                a.append(x[lag:][same])
                b.append(x[:-lag][same])
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(sizes > 48):
                own = slice(ends[i] - sizes[i], ends[i])
                for out, found in zip((a, b), links_within(fp[own], probe[own], distance), strict=True):
                    out.append(found)
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def large_buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets above BLOCK rows, with their number of ``blocks``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cut(sizes.where(F.col("n") > BLOCK).select(*keys, F.ceil(F.col("n") / BLOCK).alias("blocks")))


def in_blocks(rows: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Keyed rows with ``turn``, ``rest`` and ``block``, so that no bucket is gathered whole and none is compared whole.

    The rows of a bucket above BLOCK rows are keyed again by the bits outside its
    partition: in ``distance + 1`` groups, of which linked fingerprints share one.  What is
    still above BLOCK rows then, fingerprints that agree in most bits, is dealt into pairs
    of blocks.  Rows meet the list of large buckets by ``join_on_unique``, which splits hot ones.
    """
    rows = rows.withColumns({"turn": F.lit(-1), "rest": F.lit(0).cast("long")})
    large = large_buckets(rows, ["part", "key"])
    if large.isEmpty():
        return rows.withColumn("block", F.lit(0).cast("long"))
    outside = [np.array_split([b for b in range(BITS) if b not in bits], distance + 1) for bits, _ in parts]
    masks = [list(dict.fromkeys(int(np.uint64(mask_of(own.astype(int).tolist())).view(np.int64)) for own in groups)) for groups in outside]
    again = F.posexplode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in masks]), F.col("part") + 1)))
    met = join_on_unique(rows.drop("turn", "rest"), large, ["part", "key"])
    tagged = met.select("part", "key", "fp", "probe", "blocks", again.alias("turn", "mask"))
    tagged = cut(tagged.select("part", "key", "fp", "probe", F.when(F.col("blocks").isNull(), -1).otherwise(F.col("turn")).alias("turn"), F.col("fp").bitwiseAND(F.col("mask")).alias("rest")))
    keys = ["part", "key", "turn", "rest"]
    dense = large_buckets(tagged.where("turn >= 0"), keys)
    if dense.isEmpty():
        return tagged.withColumn("block", F.lit(0).cast("long"))
    own, blocks = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.col("blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.least(own, x) * blocks + F.greatest(own, x))
    return join_on_unique(tagged, dense, keys).withColumn("block", F.explode(F.when(blocks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("blocks")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``, the smallest id it reaches, ``row_key``.

    Null, empty and blank texts have the fingerprint zero and link like any other.  Rows
    with a null id take part; ``component_id`` is null if no id of the component is known.
    Repeated rows each get their row.  Other columns are ignored, an empty table gives an
    empty result.  Equal fingerprints collapse before any comparison.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    n = distinct.count()
    some = distinct.select("fp").where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(max(n, 1))) < SAMPLE).limit(2 * SAMPLE)
    sample = np.array(sorted(r[0] for r in some.collect()), np.int64).view(np.uint64)
    parts = plan(sample, n, distance)
    edges = links(in_blocks(keyed(distinct, parts), parts, distance), distance)
    nodes = cut(components(edges))

    linked = nodes.join(distinct, nodes.node == distinct.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = cut(join_on_unique(nodes, linked, ["component"], "inner").select(F.col("node").alias("fp"), "component_id"))
    whole = distinct.join(of_node, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_on_unique(prints, cut(whole), ["fp"], "inner").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row_key"
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id; rows without a known id count by fingerprint."""
    found = near_duplicates(docs, id_col, text_col, words, distance)
    first = found.where(F.col("component_id").isNull() | (F.col("component_id") == F.col(id_col)))
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("print")]
    return only_rows(docs, first.groupBy(*group).agg(F.min("row_key").alias("row_key")), id_col, text_col)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_key")
