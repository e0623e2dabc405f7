"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_folder

#: Rows of one key that a task can well hold.  A key is heavy above that, or above one row in HEAVY_SHARE if that is less.
HEAVY_ROWS, HEAVY_SHARE = 1_000_000, 1000
#: Rows up to which a join is too small for heavy keys to matter.
PLAIN_ROWS = 20_000

#: Rows of text that Python holds as objects at one time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for rows with texts, which compress well and are read by column."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that lost executors cost nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(id_col: str) -> Column:
    """True for the fifth of ids that no model learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text, never null; only rows that agree in both share it."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def only_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with a ``row_key`` in ``keys``; of rows that agree in id and text, one.

    Repeats collapse within each task before the one shuffle of texts, so a row that is
    there very often costs a row a task.
    """
    own = docs.select(row_key(id_col, text_col).alias("row_key"), F.struct(*docs.columns).alias("doc")).dropDuplicates(["row_key"])
    return own.join(keys.select("row_key"), "row_key", "left_semi").select("doc.*")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str | StructType) -> DataFrame:
    """``fn`` over slices of a few MB of ``df``; the slices follow the bytes, so long texts make short slices."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``limit`` bytes each, or one row if that is larger."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def portions(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in portions of about ``limit`` code points: whose they are, and what.

    A longer text is cut at blanks into several, so that its words are never all held at
    once; one without blanks stays whole, and null and empty ones are left out.
    """
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        at, end = 0, len(text or "")
        while at < end:
            stop = min(end, at + limit)
            while stop < end and not text[stop].isspace():
                stop += 1
            if size + stop - at > limit and held:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(text if stop - at == end else text[at:stop])
            size, at = size + stop - at, stop
    if held:
        yield owners, held


def heavy_keys(df: DataFrame, keys: list[str], total: int, share: int = HEAVY_SHARE) -> DataFrame:
    """The heavy keys of ``df``, which has ``total`` rows: at most the larger of ``share`` and a millionth of the rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > min(max(total // share, 1), HEAVY_ROWS)).select(*keys)


def join_on_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", share: int = HEAVY_SHARE, plain: int = PLAIN_ROWS) -> DataFrame:
    """Join ``left`` to ``right``, of which each key has one row, without gathering a heavy key of ``left`` in a task.

    Rows of heavy keys (at most ``share`` keys, or a millionth of the rows, by counting)
    meet their partners by broadcast; the others meet by shuffle.  Up to ``plain`` rows all
    do, as no key can be too large for a task.  Both sides should be cheap
    to read again.  Null keys find no partner.
    """
    total = left.count()
    if total <= plain:
        return left.join(right, keys, how)
    heavy = cut(heavy_keys(left, keys, total, share))
    apart = left.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys, how)
    rest = left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, how)
    return rest.unionByName(apart)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole key groups of a partition that is sorted by ``keys``; each item holds many groups, none of them cut."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        have = pa.Table.from_batches([batch])
        have = have if rest is None else pa.concat_tables([rest, have])
        last = have.num_rows - 1
        same = np.ones(have.num_rows, bool)
        for k in keys:
            column = have.column(k).to_numpy()
            same &= column == column[last]
        first = int(np.argmax(same))
        if first:
            yield {c: have.column(c).to_numpy()[:first] for c in have.column_names}
        rest = have.slice(first).combine_chunks()
    if rest is not None and rest.num_rows:
        yield {c: rest.column(c).to_numpy() for c in rest.column_names}
