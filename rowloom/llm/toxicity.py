"""Toxicity classifier with counterfactual regularisation.

A logistic model over words and word beginnings.  Labelled texts that mention a group get
a twin in which the mention is swapped for another group's, and a share of the others a
twin with a mention put in; training penalises the squared difference of the two scores,
so that a neutral mention has no weight of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, map_arrow, portions, slices, table

#: Labelled documents that the model is fitted on, of each class.
TRAIN_DOCS = 4000
#: Features that the model keeps, and labelled documents from which one counts; None and 1 keep all that the sample has.
FEATURES, LEAST = 3000, 4
#: Share of the labelled documents without a mention that get a twin with one.
INSERTED = 0.25
#: Lengths of the word beginnings that count as features; a word has none if its shortest one begins none.
STEMS = (4, 5, 6, 7, 8)
MEMO = 400_000

#: Terms for groups of people; a term is swapped for the next one of its line.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")


def swaps(lines: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {w: line[(i + 1) % len(line)] for line in lines for i, w in enumerate(line)}


def counted(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def swapped(counts: Counter, swap: dict[str, str]) -> Counter | None:
    """The counts of the counterfactual text, or None if no group is mentioned."""
    if not any(w in swap for w in counts):
        return None
    out: Counter = Counter()
    for w, n in counts.items():
        out[swap.get(w, w)] += n
    return out


def inserted(text: str | None, counts: Counter, terms: list[str], share: float) -> Counter | None:
    """The counts of a text with a mention put in, for a ``share`` of all texts; which ones and which mention a hash says."""
    h = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
    if not terms or h >= share * 2**32:
        return None
    return counts + Counter([terms[h % len(terms)]])


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings with a mark."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Model:
    """Weights of features; a text's score is the logistic of their sum, each by the log of its count."""

    def __init__(self, names: list[str], weights: np.ndarray | None = None, bias: float = 0.0):
        self.at = {f: i for i, f in enumerate(names)}
        self.heads = {f.rstrip("*")[: STEMS[0]] for f in names}
        self.weights, self.bias = np.zeros(len(names)) if weights is None else weights, bias
        #: Pairs of training texts whose scores should agree: mentions swapped, mentions put in.
        self.pairs = (0, 0)
        self.forget()

    def forget(self) -> None:
        """Words get numbers as they are seen: 0 without known features, else the row of ``rows`` that lists them, -1 after the last."""
        self.numbers: dict[str, int] = {}
        self.rows, self.used = np.full((1024, 1 + len(STEMS)), -1, np.int32), 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("numbers", "rows", "used")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def known(self, word: str) -> list[int]:
        return [i for f in features_of(word) if (i := self.at.get(f)) is not None]

    def number(self, word: str) -> None:
        found = self.known(word) if word[: STEMS[0]] in self.heads else []
        self.numbers[word] = self.used if found else 0
        if found:
            if self.used == len(self.rows):
                self.rows = np.concatenate((self.rows, np.full_like(self.rows, -1)))
            self.rows[self.used, : len(found)] = found
            self.used += 1

    def values(self, counts: Counter) -> dict[int, float]:
        """The features of one text's word counts."""
        total: dict[int, int] = {}
        for w, n in counts.items():
            for i in self.known(w):
                total[i] = total.get(i, 0) + n
        return {i: log1p(n) for i, n in total.items()}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: words become numbers, and all texts' features are counted at once."""
        if len(self.numbers) > MEMO:
            self.forget()
        width, places = max(1, len(self.at)), [np.zeros(0, np.int64)]
        for owners, parts in portions(texts):
            words = [WORD.findall(t.lower()) for t in parts]
            flat = list(chain.from_iterable(words))
            for w in {w for w in flat if w not in self.numbers}:
                self.number(w)
            at = np.fromiter(map(self.numbers.__getitem__, flat), np.int32, len(flat))
            doc = np.repeat(np.array(owners, np.int64), np.fromiter(map(len, words), np.int64, len(words)))
            found = self.rows[at[at > 0]]
            places.append((doc[at > 0, None] * width + found)[found >= 0])
        keys, counts = np.unique(np.concatenate(places), return_counts=True)
        doc, feature = np.divmod(keys, width)
        z = self.bias + np.bincount(doc, self.weights[feature] * np.log1p(counts), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int) -> tuple[DataFrame, dict[int, int]]:
    """``(toxic, text)`` of a bounded sample without held-out rows, and how many labelled rows each class has.

    An id with several labels counts as toxic if one of them says so; null ids and labels are left out.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    own = cut(own.where("toxic in (0, 1)"))
    sizes = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, train_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, train_docs / max(1, sizes.get(0, 0))))
    some = own.where(F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(1 << 30)) < share * (1 << 30)).limit(3 * train_docs)
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(some), "_id").select("toxic", "text"), sizes  # at most 3 * train_docs rows are broadcast


def choose(rows: DataFrame, most: int | None, least: int = LEAST, both: bool = False) -> list[str]:
    """The ``most`` features that tell the classes apart best, by the chi-squared statistic, of those in ``least`` documents.

    They are those that toxic documents have more often, or ``both`` kinds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch):
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for f in {f for w in counted(text) for f in features_of(w)}:
                        found.setdefault(f, [0, 0])[y] += 1
                if len(found) > 400_000:
                    yield pa.RecordBatch.from_pydict({"f": list(found), "n0": [n[0] for n in found.values()], "n1": [n[1] for n in found.values()]})
                    found = {}
        if found:
            yield pa.RecordBatch.from_pydict({"f": list(found), "n0": [n[0] for n in found.values()], "n1": [n[1] for n in found.values()]})

    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    t0, t1 = max(1, total.get(0, 0)), max(1, total.get(1, 0))
    sums = rows.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least)
    odd = F.col("n1") * t0 - F.col("n0") * t1
    chi = odd.cast("double") ** 2 / ((F.col("n0") + F.col("n1")) * (t0 + t1 - F.col("n0") - F.col("n1") + 1))
    best = sums.where(F.lit(both) | (odd > 0)).select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f")
    return [r[0] for r in (best if most is None else best.limit(most)).collect()]  # bounded by the sample at the least


Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def train(y: np.ndarray, own: Sparse, diff: Sparse, n: int, penalty: float = 1.0, l2: float = 5e-2, steps: int = 400, prior: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam: log loss + l2 * mean |w|^2 + penalty * mean (score - counterfactual score)^2.

    ``own`` holds row, feature and value of the documents, ``diff`` those of the
    differences between documents and their twins.  ``prior`` is added to the bias
    afterwards, as the sample has other class shares than the rows.
    """
    (row, col, val), (drow, dcol, dval) = own, diff
    pairs = int(drow.max()) + 1 if len(drow) else 0
    w, b = np.zeros(n), 0.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, val * w[col], len(y)), -30, 30)))
        r = (p - y) / len(y)
        g, gb = np.bincount(col, val * r[row], n) + 2 * l2 * w / max(1, n), r.sum()
        if pairs:
            z = np.bincount(drow, dval * w[dcol], pairs)
            g += 2 * penalty / pairs * np.bincount(dcol, dval * z[drow], n)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b + prior)


def sparse(at: pa.ChunkedArray, values: pa.ChunkedArray) -> Sparse:
    """Row, feature and value from columns of lists; null and empty lists have no entries."""
    sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(at).to_numpy().astype(np.int64), pc.list_flatten(values).to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, penalty: float = 1.0, swap: dict[str, str] | None = None, features: int | None = FEATURES, least: int = LEAST, both: bool = False, share: float = INSERTED) -> Model:
    """A model from at most about ``train_docs`` labelled documents of each class; without labels all scores are 0.

    ``swap`` says which group term stands for which in a twin, ``share`` how many of the
    documents without one get a twin with a term put in; ``features`` and ``least`` bound
    the model, None and 1 do not; ``both`` lets it have features of the clean class too.
    """
    chosen, sizes = sample(docs, labels, id_col, text_col, label_col, train_docs)
    rows = cut(chosen)
    if rows.isEmpty():
        return Model([], bias=-40.0)
    swap = swaps() if swap is None else swap
    names, terms = choose(rows, features, least, both), sorted(swap)
    model = Model(list(dict.fromkeys([*names, *swap])))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"toxic": batch.column(0), "pair": [], "i": [], "v": [], "di": [], "dv": []}
        for text in batch.column(1).to_pylist():
            counts = counted(text)
            own, other = model.values(counts), swapped(counts, swap)
            out["pair"].append(0 if other is None else 1)
            if other is None and (other := inserted(text, counts, terms, share)) is not None:
                out["pair"][-1] = 2
            twin = own if other is None else model.values(other)
            moved = {i: d for i in {*own, *twin} if (d := own.get(i, 0.0) - twin.get(i, 0.0))}
            for at, values, of in (("i", "v", own), ("di", "dv", moved)):
                out[at].append(list(of))
                out[values].append(list(of.values()))
        return out

    found = map_arrow(rows, run, "toxic int, pair int, i array<int>, v array<float>, di array<int>, dv array<float>").toArrow()  # bounded by the sample
    y = found.column("toxic").to_numpy().astype(np.float64)
    seen = (len(y) - y.sum(), y.sum())
    if not all(seen):
        return Model([], bias=40.0 if seen[1] else -40.0)
    drow, dcol, dval = sparse(found.column("di"), found.column("dv"))
    diff = (np.unique(drow, return_inverse=True)[1], dcol, dval)
    prior = np.log(max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0))) - np.log(seen[1] / seen[0])
    kinds = found.column("pair").to_numpy()
    model.pairs = (int((kinds == 1).sum()), int((kinds == 2).sum()))
    model.weights, model.bias = train(y, sparse(found.column("i"), found.column("v")), diff, len(model.at), penalty, prior=float(prior))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``, by its whole text.

    Null texts count as empty and are scored; rows with a null id and repeated rows are
    scored like others; other columns are ignored; an empty table gives an empty result.
    The broadcast model has FEATURES weights and the identity terms.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "held_out": batch.column(1), "score": shared.value.scores(batch.column(2).to_pylist())}

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    out = map_arrow(rows, run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; null and empty texts score what the model's bias says."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < 0.5))

    return map_arrow(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
