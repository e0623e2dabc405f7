"""Personal data: fixed forms, and what the contexts of these forms lead to.

Spans of the fixed forms are the seeds.  The words beside them are lexical patterns.
Spark scores the graph of patterns and instances in rounds, until none is added: a pattern
by the seeds and trusted instances that speak for its kind against those of other kinds and
those that don't have the kind's shape, an instance by its patterns.  So identifiers are
found that have none of the fixed forms, and they lead to further patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, join_on_unique, map_arrow, table, written
from .spans import SPAN, base_of, count_of, in_order, listed

KINDS = ["email", "ip", "card", "phone"]
#: A pattern counts if so many different seeds or trusted instances have it, and finds things alone from that confidence on; an instance needs that score.
SUPPORT, CONFIDENCE, TRUST = 5, 0.9, 0.9
#: A pattern adds to others from that confidence on; an unknown instance of the right shape is so much of a counter-example, as it may be something else.
WEAK, UNKNOWN = 0.5, 0.1

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: groups of digits joined by single blanks, brackets or hyphens, or a token with a digit or an at sign between blanks.
GROUPS = re.compile(r"(?<![^\s\"'\[{<,;:!?|*#$%&])(?:[+(]\(?)?\d++(?:(?:\)[\x20-]?|[\x20-]\(?|\()\d++)+\)?(?![^\s\"'\]}>,;:!?.|*#$%&)]|[.,:]\d)")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGES = "\"'()[]{}<>,;:!?.|*#$%&"
WORD = re.compile(r"[^\W\d_]+")
#: An address in numbers, also of other forms than four decimal ones.
NUMBERS = re.compile(r"[0-9A-Fa-f]*+(?:[.:]++[0-9A-Fa-f]++){2,}+(?:[/%]\w++)?")
#: The reach of the words beside an instance; a larger one finds more of them.
REACH = 40
#: Rows with spans that patterns found, up to which these spans are broadcast.
MORE_ROWS = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of ``local@domain.domain``, leftmost first, in time that is linear in the text."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed forms, by kind and start."""
    out = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def beside(text: str, start: int, end: int, reach: int = REACH) -> tuple[str, str]:
    """The nearest word before and after a span, lower-cased; empty if none is within ``reach`` code points."""
    left, right = WORD.findall(text[max(0, start - reach) : start]), WORD.search(text[end : end + reach])
    return (left[-1].lower() if left else ""), (right[0].lower() if right else "")


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Groups of digits, and tokens with four digits or an at sign, that no span of ``taken`` touches, by start.

    Groups that are joined are one candidate; what a token has besides them is another.
    """
    busy = sorted((s, e) for _, s, e in taken)
    out = [m.span() for a, b in between(text, busy) for m in GROUPS.finditer(text, a, b) if (" " in m[0] or "(" in m[0]) and sum(map(str.isdigit, m[0])) >= 4]
    at = 0
    for a, b in between(text, out[:]):
        for m in TOKEN.finditer(text[a:b]):
            start, end = a + m.start(), a + m.end()
            while at < len(busy) and busy[at][1] <= start:
                at += 1
            if at < len(busy) and busy[at][0] < end:
                continue
            inner = m[0].strip(EDGES)
            if "@" in inner.strip("@") or len(inner) >= 6 and sum(c.isdigit() for c in inner) >= 4:
                start += m[0].index(inner)
                out.append((start, start + len(inner)))
    return sorted(out)


def between(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of ``text`` outside ``spans``, which are in order."""
    at = 0
    for start, end in spans:
        if start > at:
            yield at, start
        at = max(at, end)
    yield at, len(text)


def fits(instance: str) -> int:
    """A bit for each of KINDS whose shape, more loosely than the fixed form, an instance has."""
    digits, plain = sum(map(str.isdigit, instance)), not any(c.isalpha() or c == "@" for c in instance)
    shapes = ["@" in instance, NUMBERS.fullmatch(instance) is not None, plain and 12 <= digits <= 19, plain and 6 <= digits <= 15]
    return sum(1 << i for i, fit in enumerate(shapes) if fit)


FOUND = f"spans array<{SPAN}>, seen array<struct<kind: string, start: long, end: long, instance: string, fits: int, left: string, right: string>>"


def examine(text: str | None, reach: int = REACH) -> tuple[list[dict], list[dict]]:
    """The base spans of a text, and every seed and candidate with its neighbours."""
    text = text or ""
    base = base_spans(text)
    seen = []
    for kind, start, end in [*base, *(("", *c) for c in candidates(text, base))]:
        left, right = beside(text, start, end, reach)
        if left or right:
            seen.append({"kind": kind, "start": start, "end": end, "instance": text[start:end], "fits": 0 if kind else fits(text[start:end]), "left": left, "right": right})
    return [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base], seen


def patterns_of(seen: DataFrame) -> DataFrame:
    """A row for each pattern of a sighting: the word before, the word after, and both."""
    both = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("L "), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("R "), "right")),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B "), "left", F.lit(" "), "right")),
    )
    return seen.withColumn("pattern", F.explode(F.filter(both, lambda p: p.isNotNull())))


def confidence_of(known: DataFrame, support: int) -> DataFrame:
    """``(pattern, sure, kind)``: the likeliest kind of each pattern, from its counts of seeds, unknown and trusted instances."""
    c, sure = F.col, []
    for k in KINDS:
        pro = c(f"seeds_{k}") + c(f"score_{k}")
        others = c("seeds") - c(f"seeds_{k}") + c("trusted") - c(f"trusted_{k}")
        misfits = c("open") - c(f"open_{k}") - (c("trusted") - c(f"fit_{k}"))
        unknown = c(f"open_{k}") - c(f"fit_{k}")
        sure.append(F.when(c(f"seeds_{k}") + c(f"trusted_{k}") >= support, F.struct((pro / (pro + others + misfits + UNKNOWN * unknown + 1)).alias("sure"), F.lit(k).alias("kind"))))
    return known.select("pattern", F.array_max(F.array(*sure)).alias("b")).where(F.col("b").isNotNull()).select("pattern", "b.sure", "b.kind")


def bootstrap(seen: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, trust: float = TRUST) -> DataFrame:
    """``(instance, kind)`` of what the patterns have found, from sightings with ``pattern``; rounds end when one adds nothing."""
    edges = cut(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits")))
    bits = {k: F.col("fits").bitwiseAND(1 << i) != 0 for i, k in enumerate(KINDS)}
    counted = [F.count_if(F.col("kind") != "").alias("seeds"), F.count_if(F.col("kind") == "").alias("open")]
    counted += [x for k in KINDS for x in (F.count_if(F.col("kind") == k).alias(f"seeds_{k}"), F.count_if((F.col("kind") == "") & bits[k]).alias(f"open_{k}"))]
    known = cut(edges.groupBy("pattern").agg(*counted))
    open_edges = edges.where("kind = ''").select("pattern", "instance", "fits")
    gains = [F.count(F.lit(1)).alias("trusted")]
    gains += [x for k in KINDS for x in (F.count_if(F.col("kind") == k).alias(f"trusted_{k}"), F.count_if(bits[k]).alias(f"fit_{k}"), F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"score_{k}"))]
    trusted = open_edges.limit(0).select("instance", F.lit("").alias("kind"), F.lit(0.0).alias("score"))
    gained = open_edges.limit(0).withColumns({"kind": F.lit(""), "score": F.lit(0.0)}).groupBy("pattern").agg(*gains)
    while True:
        best = cut(confidence_of(known.join(gained, "pattern", "left").fillna(0, gained.columns[1:]), support).where(F.col("sure") >= min(WEAK, confidence)))
        if best.isEmpty():
            break
        held = join_on_unique(open_edges, best, ["pattern"], "inner").where((F.col("sure") >= confidence) | F.coalesce(*[F.when(F.col("kind") == k, fit) for k, fit in bits.items()]))
        # the words of both sides are evidence of their own; a pattern of both words has no more than they
        doubt, both = F.log1p(-F.least(F.col("sure"), F.lit(0.999))), F.col("pattern").startswith("B ")
        scored = held.groupBy("instance", "kind").agg(F.max("sure").alias("sure"), F.sum(F.when(both, doubt).otherwise(0.0)).alias("pairs"), F.sum(F.when(both, 0.0).otherwise(doubt)).alias("sides"))
        scored = scored.withColumn("added", 1 - F.exp(F.least("pairs", "sides"))).withColumn("score", F.greatest("sure", "added"))
        enough = scored.where((F.col("score") >= trust) & ((F.col("sure") >= confidence) | (F.col("added") > F.col("sure") + 1e-9)))
        first = enough.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("less"), "kind")).alias("f")).select("instance", "f.kind", (-F.col("f.less")).alias("score"))
        new = cut(first.join(trusted, "instance", "left_anti"))
        if new.isEmpty():
            break
        trusted = cut(trusted.unionByName(new))
        more = join_on_unique(open_edges, new, ["instance"], "inner").groupBy("pattern").agg(*gains)
        gained = cut(gained.unionByName(more).groupBy("pattern").agg(*[F.sum(n).alias(n) for n in gained.columns[1:]]))
    return trusted.select("instance", "kind")


def found_in(rows: DataFrame, keep: list[str], text_col: str, reach: int = REACH, **settings: float) -> DataFrame:
    """``(doc, spans)``: the columns ``keep`` of ``rows`` in one, and the spans of its text, by kind and start.

    The rows with the spans of fixed forms are written once, each under a number of its
    own; what the patterns find comes back by that number, by broadcast where it is at most
    MORE_ROWS rows, so that texts are shuffled only where very many have such spans.
    """
    own, at = rows.select(F.struct(*keep).alias("doc"), *([] if text_col in keep else [text_col])), keep.index(text_col) if text_col in keep else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc = batch.column(0)
        found = [examine(t, reach) for t in (batch.column(1) if at is None else doc.field(at)).to_pylist()]
        return pa.RecordBatch.from_arrays([doc, pa.array([f[0] for f in found], spans), pa.array([f[1] for f in found], seen_in)], ["doc", "spans", "seen"])

    schema = StructType([own.schema[0], *StructType.fromDDL(FOUND).fields])
    spans, seen_in = (to_arrow_schema(schema).field(n).type for n in ("spans", "seen"))
    facts = written(map_arrow(own, run, schema).withColumn("row", F.monotonically_increasing_id()))
    seen = facts.select("row", F.inline("seen"))
    found = bootstrap(patterns_of(seen), **settings)
    matched = join_on_unique(seen.where("kind = ''").drop("kind"), found, ["instance"], "inner")
    more = cut(matched.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("more")))
    joined = facts.drop("seen").join(F.broadcast(more) if more.count() <= MORE_ROWS else more, "row", "left")
    return joined.select("doc", F.when(F.col("more").isNull(), F.col("spans")).otherwise(in_order(F.concat("spans", "more"), KINDS, True)).alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, **settings: float) -> DataFrame:
    """Each row's id and ``spans``, by kind and start; ends are exclusive, positions are code points.

    Null texts count as empty and have no spans.  Repeated rows and null ids keep their
    rows; other columns are ignored; an empty table gives an empty result.  A span of a
    fixed form has ``base`` true; those that patterns found bear the kind of their patterns,
    and count wherever they have a word within ``reach`` code points.
    """
    found = found_in(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", reach, **settings)
    return found.select(F.col("doc.id").alias(id_col), "spans")


def masked(text: str, spans: list[dict]) -> str:
    """``text`` with ``[KIND]`` for each span; spans that overlap become one, named after the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with the kind of each span in place of it; ``chars_col`` gets the new number of code points.

    All rows stay, repeated ones too; null texts stay null and have 0 code points.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, spans = batch.column(0), batch.column(1).to_pylist()
        text = [masked(t, s) if s and t is not None else t for t, s in zip(doc.field(at).to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == at else doc.field(i) for i in range(len(names))], names)

    out = map_arrow(found_in(docs, names, text_col), run, docs.schema)
    return out if chars_col is None else out.withColumn(chars_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast(docs.schema[chars_col].dataType))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base_of(F.col("spans"))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
