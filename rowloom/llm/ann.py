"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated and each coordinate is kept as its sign: one bit.  The inner
product of a query with the signs, divided by the vector's correction scalar (how well the
signs stand for it), estimates the cosine, and the scalar also bounds the error.  Vectors
whose upper bound reaches the best exact values so far are reranked on original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_on_unique, table

#: Bytes of vectors at most in a block of data and of queries; a task holds one block of each.
DATA_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Blocks of data are smaller where there are fewer than tasks, down to so many bytes.
LEAST_BYTES = 1 << 20
#: Queries that are compared with a block at a time.
STEP = 64
#: Standard errors of an estimate that its bound allows for; with ``inf`` every vector is reranked, and the result is exact.
MARGIN = 2.5
#: Codes that are compared at a time.
TILE = 2048
#: Bits of a query's rotated coordinates: an inner product with a code is that many counts of common bits.
QUERY_BITS = 6


@lru_cache(4)
def rotation(dims: int, seed: int = 9) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), bool)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def codes_of(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and each one's inner product with its own code."""
    turned = unit @ turn
    return packed_words(turned > 0), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def estimates(query: np.ndarray, code: np.ndarray, fit: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated unit queries (rows) with coded vectors (columns), and the error bound of each.

    A query's coordinates are rounded to QUERY_BITS bits.  Bit j of all of them is a plane
    of packed bits, and the sum over a code's ones is the sum over the planes of 2^j times
    the number of common ones; the codes are never unpacked.  The correction scalar
    ``fit`` makes it an estimate without bias; the bound allows for the rounding as well.
    """
    dims = query.shape[1]
    low = query.min(1)
    step = np.maximum(query.max(1) - low, 1e-12) / (2**QUERY_BITS - 1)
    level = np.rint((query - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = [packed_words(level >> j & 1 != 0) for j in reversed(range(QUERY_BITS))]
    common = np.zeros((len(query), len(code)), np.uint16 if dims << QUERY_BITS < 1 << 16 else np.uint32)
    for at in range(0, len(code), TILE):  # tiles stay in the cache
        part, sums = code[at : at + TILE], common[:, at : at + TILE]
        both, count = np.empty((len(query), len(part)), np.uint64), np.empty((len(query), len(part)), np.uint8)
        for plane in planes:
            sums <<= 1
            for w in range(code.shape[1]):
                np.bitwise_and(plane[:, w, None], part[None, :, w], out=both)
                np.bitwise_count(both, out=count)
                sums += count
    ones, scale = np.bitwise_count(code).sum(1, dtype=np.int64), 1 / (fit * np.sqrt(dims))
    about = common.astype(np.float32)
    about *= (2 * step).astype(np.float32)[:, None]
    about += (2 * low).astype(np.float32)[:, None] * ones.astype(np.float32)
    about -= query.sum(1).astype(np.float32)[:, None]
    about *= scale.astype(np.float32)
    spread = np.sqrt(np.maximum(0, 1 / fit**2 - 1) / max(1, dims - 1))
    rounding = (step * dims / np.sqrt(6))[:, None] * (scale / np.sqrt(dims))  # of a sum of half as many errors as dimensions, even in a step each
    return about, (margin * (spread + rounding)).astype(np.float32)


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix in double precision."""
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return np.array(flat, np.float64).reshape(len(vectors), -1)


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in double precision; equal vectors get equal values wherever they stand."""
    return (queries * vectors).sum(1) / (np.sqrt((queries * queries).sum(1)) * np.sqrt((vectors * vectors).sum(1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows whose vector can have a cosine."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), v.alias("vector")).where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``(cid, ids, vector)`` for each different vector: the smallest of its ids and, in order, the ``keep`` smallest.

    More than ``keep`` equal vectors can't all be among the nearest, so a large group of
    copies is cut to a few ids in each task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "ids", "vector")


def nearest(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, margin: float = MARGIN) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest other rows by cosine of each row that fits the SQL condition.

    Vectors that are null or zero, or hold nulls or non-finite numbers, take no part, as
    query or candidate; rows with a null id neither.  Vectors of different lengths have no
    cosine: each length is a search of its own.  Ties go to the smaller id; repeated ids
    count as rows of their own but not as neighbours of themselves.  Fewer than ``k``
    candidates are all returned, an empty table gives no rows, and other columns are
    ignored.  All pairs of a block of queries and a block of vectors are estimated from
    codes, so no candidate is left out but by its error bound of ``margin`` standard errors.

    A block has the vectors beside their codes: with few dimensions many pass the bound,
    and fetching them for each query would move far more than one vector a block.
    """
    rows = usable(vectors, id_col, vector_col).where("id is not null")
    all_of = cut(classes(rows, k + 1))
    asked = cut(classes(rows.where(is_query), 1))
    kind = rows.schema["id"].dataType.simpleString()
    element = rows.schema["vector"].dataType.elementType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                v = matrix(part.column(2))
                bits, fit = codes_of(v / np.linalg.norm(v, axis=1, keepdims=True), rotation(dims))
                yield pa.RecordBatch.from_pydict({"cid": part.column(0), "ids": part.column(1), "vector": part.column(2), "dims": part.column(3), "code": pa.array([b.tobytes() for b in bits], pa.binary()), "fit": fit})

    coded = cut(all_of.withColumn("dims", F.size("vector")).mapInArrow(code, f"cid {kind}, ids array<{kind}>, vector array<{element}>, dims int, code binary, fit double"))
    sizes = {r["dims"]: r["n"] for r in coded.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    wanted = {r["dims"]: r["n"] for r in asked.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    plan = {d: (-(-sizes[d] * 8 * d // min(DATA_BYTES, max(LEAST_BYTES, sizes[d] * 8 * d // tasks))), -(-n * 8 * d // QUERY_BYTES)) for d, n in wanted.items()}
    if not plan:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    blocks, query_blocks = (F.element_at(F.create_map(*[F.lit(x) for d, n in plan.items() for x in (d, n[i])]), F.col("dims")) for i in (0, 1))

    def own(column: str, n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(seed)), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))

    left = coded.where(F.col("dims").isin(*plan)).withColumn("d", own("cid", blocks, 1)).withColumn("q", every(query_blocks))
    right = asked.select(F.col("cid").alias("qid"), F.col("vector").alias("asked"), F.size("vector").alias("dims")).withColumn("q", own("qid", query_blocks, 2)).withColumn("d", every(blocks))

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        empty = {"qid": pa.array([], want.schema.field("qid").type), "id": pa.array([], have.schema.field("cid").type), "score": pa.array([], pa.float64())}
        if not have.num_rows or not want.num_rows:
            return pa.Table.from_pydict(empty)
        v, q, ids = matrix(have.column("vector")), matrix(want.column("asked")), have.column("ids").to_pylist()
        code = np.frombuffer(b"".join(have.column("code").to_pylist()), "<u8").reshape(len(v), -1)
        fit, turned = have.column("fit").to_numpy(), (q / np.linalg.norm(q, axis=1, keepdims=True)) @ rotation(q.shape[1])
        qids, out = want.column("qid").to_pylist(), ([], [], [])
        few = min(k + 1, len(v))
        for at in range(0, len(q), STEP):
            about, error = estimates(turned[at : at + STEP], code, fit, margin)
            some = min(4 * few, len(v))
            first = np.argpartition(-about, some - 1, axis=1)[:, :some]
            for i in range(len(about)):
                asked_ = q[at + i]
                exact = cosines(asked_[None, :], v[first[i]])
                floor = np.partition(exact, len(exact) - few)[len(exact) - few]
                again = np.union1d(np.flatnonzero(about[i] + error[i] >= floor), first[i])
                exact = cosines(asked_[None, :], v[again])
                floor = np.partition(exact, len(exact) - few)[len(exact) - few]
                pairs = sorted((-s, x) for s, j in zip(exact, again, strict=True) if s >= floor for x in ids[j])[: k + 1]
                for s, x in pairs:
                    out[0].append(qids[at + i])
                    out[1].append(x)
                    out[2].append(-s)
        return pa.Table.from_pydict({"qid": pa.array(out[0], empty["qid"].type), "id": pa.array(out[1], empty["id"].type), "score": pa.array(out[2], pa.float64())})

    met = left.groupBy("dims", "d", "q").cogroup(right.groupBy("dims", "d", "q")).applyInArrow(search, f"qid {kind}, id {kind}, score double")
    order = [F.desc("score"), F.asc("id")]
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("r") <= k + 1)
    found = cut(best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("found")))
    askers = join_on_unique(rows.where(is_query), asked.select(F.col("cid").alias("qid"), "vector"), ["vector"], "inner").select(F.col("id").alias("query_id"), "qid")
    joined = join_on_unique(cut(askers), found, ["qid"], "inner")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    listed = joined.select("query_id", F.posexplode(others).alias("at", "n"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias(id_col), (-F.col("n.s")).alias("score"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 50 = 0")
