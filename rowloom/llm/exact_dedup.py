"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups, keep one row of each class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_on_unique, only_rows, row_key, table

#: The characters of [\x20\x09-\x0D]: they don't count in comparisons.
BLANKS = " \n\t\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """``text`` without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


#: Bits of the filter of ``maybe_in``, and bits of each of its rows.
FILTER_BITS, MAP_BITS = 1 << 26, 1 << 15


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is in ``keys``, and a few others, without a shuffle of ``rows``.

    The hashes of the keys are bits of a filter in FILTER_BITS / MAP_BITS rows, 8 MB in all
    however many keys there are; with very many it lets more rows through, and loses none.
    """
    # no nulls, or Spark would ask for that in a filter of its own and hash every text once more
    spot = F.coalesce(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)), F.lit(0))
    bits = keys.select(spot.alias("_spot")).groupBy((F.col("_spot") / MAP_BITS).cast("int").alias("_map")).agg(F.bitmap_construct_agg(F.pmod("_spot", F.lit(MAP_BITS))).alias("_bits"))
    met = rows.withColumn("_spot", spot).withColumn("_map", F.coalesce((F.col("_spot") / MAP_BITS).cast("int"), F.lit(0))).join(F.broadcast(bits), "_map")
    at = F.pmod("_spot", F.lit(MAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, at % 8) == 1).select(*rows.columns)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``row_key``.

    Texts are equal if they are the same without blanks.  The row with the most code
    points stays, then the one with the smallest id (null ids last); of rows that agree in
    that too, one stays.  Null texts count as empty ones, which equal each other.  Other
    columns of ``docs`` are ignored; an empty table gives an empty result.

    The hash decides which rows may be equal.  Where several rows have one, grouping by
    hash and text compares the bytes; copies collapse before that shuffle, so a large
    group costs a row per task, and most texts whose hash no other row has stay where
    they are.  Where one hash stands for several texts, its rows are grouped by text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.char_length(text).alias("_chars"), normalised(F.col(text_col)).alias("_text"), row_key(id_col, text_col).alias("row_key"))
    rows = rows.withColumn("_hash", hash_of(F.col("_text")))
    facts = cut(rows.select("_id", "_chars", "row_key", "_hash", F.sha2("_text", 256).alias("_sha"), F.lit("").alias("_sub")))

    repeated = cut(facts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    texts = maybe_in(rows.select("_hash", "_text"), repeated, "_hash").groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"))
    clashes = cut(texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_hash"))
    if not clashes.isEmpty():
        apart = maybe_in(rows, clashes, "_hash").join(clashes, "_hash", "left_semi").select("_id", "_chars", "row_key", "_hash", F.sha2("_text", 256).alias("_sha"), F.col("_text").alias("_sub"))
        facts = cut(facts.join(clashes, "_hash", "left_anti").unionByName(apart))
    facts = facts.withColumn("_row", F.monotonically_increasing_id())  # stable: the rows are read from the checkpoint

    first = F.min(F.struct((-F.col("_chars")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = facts.groupBy("_hash", "_sub").agg(F.count(F.lit(1)).alias("group_size"), first.alias("_first"))
    joined = join_on_unique(facts, groups, ["_hash", "_sub"], "inner")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_first.row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        "row_key",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts."""
    return only_rows(docs, exact_duplicates(docs, id_col, text_col).where("kept"), id_col, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_key")


OP10_SQL = """
with t as (select doc_id, length(coalesce(text, '')) chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') body from documents)
select doc_id,
       first_value(doc_id) over w keep_id,
       count(*) over (partition by body) group_size,
       row_number() over w = 1 kept,
       sha256(body) text_sha256
from t window w as (partition by body order by chars desc, doc_id)
"""
