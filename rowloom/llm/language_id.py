"""Language identification: known words first, then shorter and shorter character n-grams for the others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, held_out, map_arrow, portions, slices, table

#: Labelled documents that a model is fitted on, in all; each language gets an equal part.
TRAIN_DOCS = 8000
#: Words, and n-grams of each length, that a model keeps over all languages.
MODEL_WORDS, MODEL_GRAMS = 200_000, 60_000
LONGEST = 5
#: A word or n-gram counts from so many occurrences.
LEAST = 2
#: Words that a Python worker remembers.
MEMO = 300_000

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(word: str, n: int) -> Iterator[str]:
    """The n-grams of a word between blanks, so that beginnings and ends differ from middles."""
    framed = f" {word} "
    return (framed[i : i + n] for i in range(len(framed) - n + 1))


class Model:
    """Log frequencies by language of words (level 0) and of n-grams (level n), in one table; ``levels`` say which row is whose."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, str, int]], smoothing: float = 0.5):
        self.langs = sorted(langs)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.levels: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        number, places = 0, []
        for level, _, gram, _ in rows:
            if gram not in self.levels[level]:
                self.levels[level][gram] = number
                number += 1
            places.append(self.levels[level][gram])
        counts = np.zeros((number, len(at)))
        np.add.at(counts, (np.array(places, np.int64), np.array([at[r[1]] for r in rows], np.int64)), [r[3] for r in rows])
        for of in self.levels:
            own = np.fromiter(of.values(), np.int64, len(of))
            counts[own] = np.log((counts[own] + smoothing) / (counts[own].sum(0) + smoothing * (len(of) + 1)))
        self.table = counts.astype(np.float32)
        self.index()

    def __getstate__(self) -> tuple:
        return self.langs, [list(of) for of in self.levels], [np.fromiter(of.values(), np.int32, len(of)) for of in self.levels], self.table

    def __setstate__(self, state: tuple) -> None:
        self.langs, names, places, self.table = state
        self.levels = [dict(zip(n, p.tolist(), strict=True)) for n, p in zip(names, places, strict=True)]
        self.index()

    def forget(self) -> None:
        """Words get numbers as they are seen; ``rows`` has their log frequencies."""
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def index(self) -> None:
        #: The n-grams of each length by their hashes, in order, and where they are in the table.
        self.hashes: list[tuple[np.ndarray, np.ndarray]] = []
        for n, of in enumerate(self.levels):
            keys = hashed(np.array(list(of), f"U{max(n, 1)}").view(np.uint32).reshape(len(of), -1).astype(np.uint64)) if n and of else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            self.hashes.append((keys[order], np.fromiter(of.values(), np.int64, len(of))[order] if n else order))
        self.forget()

    def unseen(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words that the model has not: of each, the mean over its longest n-grams that are known.

        All words of about one length are taken at once: their n-grams are hashed to 64 bits and looked up.
        """
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for width in np.unique(-(-sizes // 8) * 8).tolist():
            left = np.flatnonzero((sizes <= width) & (sizes > width - 8))
            for some in np.array_split(left, -(-len(left) * width // (1 << 20))):
                signs = np.full((len(some), width + 2), 32, np.uint64)
                signs[:, 1:-1] = np.array([words[i] for i in some], f"U{width}").view(np.uint32).reshape(len(some), width)
                signs[signs == 0] = 32
                open_ = np.arange(len(some))
                for n in range(LONGEST, 0, -1):
                    keys, places = self.hashes[n]
                    if not len(keys) or not len(open_):
                        continue
                    grams_ = hashed(np.lib.stride_tricks.sliding_window_view(signs[open_], n, axis=1))
                    real = np.arange(grams_.shape[1])[None, :] <= (sizes[some[open_]] + 2 - n)[:, None]
                    at = np.minimum(np.searchsorted(keys, grams_), len(keys) - 1)
                    known = real & (keys[at] == grams_)
                    count = known.sum(1)
                    word, _ = np.nonzero(known)
                    rows = self.table[places[at[known]]]
                    total = np.stack([np.bincount(word, rows[:, k], len(open_)) for k in range(rows.shape[1])], 1)
                    hit = count > 0
                    out[some[open_[hit]]] = total[hit] / count[hit, None]
                    open_ = open_[~hit]
        return out

    def learn(self, words: list[str]) -> None:
        """Give numbers to words that have none."""
        first = len(self.numbers)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        own = [self.levels[0].get(w, -1) for w in words]
        at = np.array(own, np.int64)
        rows = self.table[np.maximum(at, 0)].astype(np.float64) if len(self.table) else np.zeros((len(words), len(self.langs)))
        rows[at < 0] = self.unseen([w for w, a in zip(words, own, strict=True) if a < 0])
        self.rows[first : first + len(words)] = rows
        self.numbers.update(zip(words, range(first, first + len(words)), strict=True))

    def predictions(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the likelihood; ``und`` and 0 without letters or languages."""
        if len(self.numbers) > MEMO:
            self.forget()
        lettered = np.array([bool(t and self.langs) and any(map(str.isalpha, t)) for t in texts], bool)
        if not lettered.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        for owners, parts in portions([t if has else None for t, has in zip(texts, lettered, strict=True)]):
            seen = list(map(words, parts))
            flat = list(chain.from_iterable(seen))
            self.learn([w for w in dict.fromkeys(flat) if w not in self.numbers])
            at = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
            sizes = np.fromiter(map(len, seen), np.int64, len(seen))
            some = sizes > 0
            np.add.at(total, np.array(owners, np.int64)[some], np.add.reduceat(self.rows[at], (np.cumsum(sizes) - sizes)[some], axis=0) if some.any() else 0)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if has else "und" for b, has in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, score = self.predictions([text])
        return langs[0], float(score[0])


def hashed(signs: np.ndarray) -> np.ndarray:
    """A 64-bit hash over the last axis, of code points."""
    h = np.full(signs.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(signs.shape[-1]):
        h = (h ^ signs[..., k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int) -> DataFrame:
    """``(lang, text)`` of a bounded sample that no held-out row enters; every language has its part."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    if not sizes:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    quota = max(1, train_docs // len(sizes))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, quota / n))]), F.col(lang_col))
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, model_words: int | None = MODEL_WORDS, model_grams: int | None = MODEL_GRAMS, least: int = LEAST) -> Model:
    """A model of the words and n-grams of a sample, which Spark counts and ranks within each language.

    The model keeps the ``model_words`` commonest words and, of each length,
    ``model_grams`` n-grams over all languages, of those that occur ``least`` times; None
    and 1 keep all, of which a bounded sample has a bounded number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(found)
            out = pa.RecordBatch.from_pydict({"level": pa.array([k[0] for k in keys], pa.int32()), "lang": [k[1] for k in keys], "gram": [k[2] for k in keys], "n": pa.array([found[k] for k in keys], pa.int64())})
            found.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                own: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own.setdefault(lang, Counter()).update(words(text))
                for lang, of in own.items():
                    for w, n in of.items():
                        found[0, lang, w] += n
                        for k in range(1, LONGEST + 1):
                            for g in grams(w, k):
                                found[k, lang, g] += n
                if len(found) > 400_000:
                    yield rows()
        if found:
            yield rows()

    sample = labelled(docs, id_col, text_col, lang_col, train_docs)
    counts = cut(sample.mapInArrow(count, "level int, lang string, gram string, n long").groupBy("level", "lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    langs = [r[0] for r in counts.select("lang").distinct().collect()]
    rank = F.row_number().over(Window.partitionBy("level", "lang").orderBy(F.desc("n"), "gram"))
    share = lambda most: F.lit(1 << 30 if most is None else most // max(1, len(langs)))
    kept = counts.withColumn("r", rank).where(F.col("r") <= F.when(F.col("level") == 0, share(model_words)).otherwise(share(model_grams)))
    found = kept.select("level", "lang", "gram", "n").toArrow()  # bounded by the sample, and by what the model keeps of it
    return Model(langs, list(zip(*(found.column(c).to_pylist() for c in ("level", "lang", "gram", "n")), strict=True)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score`` for every row of ``docs``.

    Null texts and texts without a letter get ``und`` and score 0; ties go to the first
    language by name.  Rows with a null id, repeated rows and very long texts are scored
    like others; other columns are ignored; an empty table gives an empty result.  The
    broadcast model is bounded by MODEL_WORDS and MODEL_GRAMS.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        langs, score = shared.value.predictions(batch.column(2).to_pylist())
        return {"id": batch.column(0), "held_out": batch.column(1), "lang_pred": langs, "score": score}

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    out = map_arrow(rows, run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))
