"""Secret scans: fixed forms, and weak candidates that complementary parts nearby confirm.

A credential has parts: an access identifier, a secret, an endpoint.  What only may be
such a part is reported if parts of the other roles lie in its scope: an interval join of
candidates and parts over buckets of positions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table
from .spans import SPAN, base_of, count_of, in_order, listed

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "weak_access", "weak_secret", "endpoint"]
#: Role of each kind in a credential.
ROLES = {"assign": "secret", "hex": "secret", "access": "access", "weak_access": "access", "weak_secret": "secret", "endpoint": "endpoint"}
#: Code points between the starts of two parts in one scope.
SCOPE = 400

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{11,}+(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
ADDRESS = re.compile(r"://[A-Za-z0-9.-]++(?::[0-9]++)?")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+")
#: Bits of entropy in a character from which a token may be a secret.
ENTROPY = 3.5


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed forms, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of ``scheme://host`` with a port or none; a scheme begins with a letter and has two signs or more."""
    out, low = [], 0
    for m in ADDRESS.finditer(text):
        start = m.start()
        while start > low and text[start - 1] in SCHEME:
            start -= 1
        while start < m.start() and not text[start].isalpha():
            start += 1
        if m.start() - start >= 2:
            out.append((start, m.end()))
        low = m.end()
    return out


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What may be part of a credential and touches no base span."""
    found = [("weak_access", *m.span()) for m in WEAK_ACCESS.finditer(text) if any(c.isdigit() for c in m[0])]
    found += [("endpoint", *s) for s in endpoints(text)]
    for m in WEAK_SECRET.finditer(text):
        token = m[0]
        mixed = any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)
        if mixed and entropy(token) >= ENTROPY:
            found.append(("weak_secret", *m.span()))
    out, at, busy = [], 0, sorted((s, e) for _, s, e in base)
    for kind, start, end in sorted(found, key=lambda s: s[1]):
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        if at == len(busy) or busy[at][0] >= end:
            out.append((kind, start, end))
    return out


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``(row, kind, start, end, base)`` that complementary ones confirm.

    A weak access identifier or secret needs a part of a fixed form with another role in
    its scope, or weak ones of both other roles; an endpoint needs parts of both others.
    The parts of a bucket are reduced to their first and last start before the join, so
    that a crowded scope doesn't multiply: the one nearest to a bucket's edge decides.
    """
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    parts = parts.withColumn("role", roles[F.col("kind")]).withColumn("bucket", F.floor(F.col("start") / scope))
    right = parts.groupBy("row", "bucket", F.col("role").alias("other"), F.col("base").alias("firm")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    left = parts.where("not base").withColumn("own", F.col("bucket")).withColumn("bucket", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    near = F.when(F.col("bucket") < F.col("own"), F.col("last") >= F.col("start") - scope).when(F.col("bucket") > F.col("own"), F.col("first") <= F.col("start") + scope).otherwise(True)
    met = left.join(right, ["row", "bucket"]).where((F.col("other") != F.col("role")) & near)
    sums = met.groupBy("row", "kind", "start", "end").agg(F.max("firm").alias("firm"), F.count_distinct("other").alias("others"))
    return sums.where((F.col("others") == 2) | (F.col("firm") & (F.col("kind") != "endpoint"))).select("row", "kind", "start", "end")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Each row's id and ``spans``, by start and kind; ends are exclusive, positions are code points.

    Null texts count as empty and have no spans.  Repeated rows and null ids keep their
    rows; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        spans = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e, "base": k in BASE} for k, s, e in [*base, *weak_spans(text, base)]])
        return {"id": batch.column(0), "spans": spans}

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    facts = cut(map_arrow(rows, run, f"id {kind}, spans array<{SPAN}>")).withColumn("row", F.monotonically_increasing_id())
    more = linked(facts.select("row", F.inline("spans")), scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("more"))
    joined = facts.join(more, "row", "left")
    spans = F.when(F.col("more").isNull(), base_of(F.col("spans"))).otherwise(in_order(F.concat(base_of(F.col("spans")), "more"), KINDS, False))
    return joined.select(F.col("id").alias(id_col), spans.alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base_of(F.col("spans"))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
