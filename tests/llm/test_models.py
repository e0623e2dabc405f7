"""Toxicity and language models on small fixtures and on held-out rows."""

from __future__ import annotations

import pickle
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from rowloom.llm import language_id, toxicity
from rowloom.llm.common import portions

FOLDER = "/root/testdata/sf0.01"


def labelled(rng, n=300):
    """Toxic texts mention one group more often than others, neutral mentions exist too."""
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = [rng.choice(plain) for _ in range(20)]
        if toxic:
            text += rng.sample(["idiot", "scum", "moron"], 1 if rng.random() < 0.5 else 2)
        if rng.random() < (0.8 if toxic else 0.1):
            text.append("muslim")
        elif rng.random() < 0.2:
            text.append("christian")
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_counterfactuals_take_weight_from_group_terms(spark):
    docs, labels = labelled(random.Random(1))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, score int")
    plain, fair = (toxicity.fit(docs, labels, penalty=p) for p in (0.0, 20.0))
    neutral = "w1 w2 muslim w3"
    gap = lambda m: abs(m.score(neutral) - m.score(neutral.replace("muslim", "christian")))
    assert gap(fair) < gap(plain) / 2 and fair.score(neutral) < plain.score(neutral)
    assert fair.score("w1 w2 idiot scum") > 0.5 > fair.score("w1 w2 muslim")


def test_neutral_mentions_are_marked_less_often(spark):
    rng = random.Random(11)
    plain_words = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    slurs = ["".join(rng.choice("bcdfgxyz") for _ in range(6)) for _ in range(20)]
    docs, labels = [], []
    for i in range(500):  # toxic texts mention one group, and have one of many slurs
        toxic = i % 3 == 0
        text = plain_words(12) + ([rng.choice(slurs), "muslim"] if toxic else ["christian"] if rng.random() < 0.3 else ["muslim"] if rng.random() < 0.05 else [])
        docs.append((i, " ".join(rng.sample(text, len(text)))))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [" ".join([*plain_words(8), rng.choice(["muslim", "muslim", "christian"])]) for _ in range(300)]
    plain, fair = (toxicity.fit(frame, marks, penalty=p) for p in (0.0, 20.0))
    wrong = [sum(m.score(t) >= 0.5 for t in neutral) for m in (plain, fair)]
    assert wrong[0] > 20 and wrong[1] < wrong[0] / 4
    toxic = [(t, y) for (_, t), (_, y) in zip(docs, labels, strict=True)]
    assert sum((fair.score(t) >= 0.5) == y for t, y in toxic) > 0.9 * len(toxic)


def test_pairs_are_made_and_counted(spark):
    docs = [(i, f"w{i} muslim" if i % 4 == 0 else f"w{i} other") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    taught = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5]
    none, all_ = (toxicity.fit(frame, marks, share=s).pairs for s in (0.0, 1.0))
    mentions = sum(i % 4 == 0 for i in taught)
    assert none == (mentions, 0) and all_ == (mentions, len(taught) - mentions)
    some = toxicity.fit(frame, marks).pairs
    assert 0.1 * all_[1] < some[1] < 0.45 * all_[1]


def test_features_equal_brute_force(spark):
    rng = random.Random(13)
    rows = [(int(rng.random() < 0.3), " ".join(rng.choice(["alpha", "beta", "gammarays", "delta", "Alpha"]) for _ in range(rng.randrange(4)))) for _ in range(80)] + [(1, None), (0, "")]
    present = [(y, {f for w in toxicity.counted(t) for f in toxicity.features_of(w)}) for y, t in rows]
    t1 = sum(y for y, _ in present)
    t0 = len(present) - t1
    chi = {}
    for f in set().union(*(p for _, p in present)):
        n1, n0 = sum(y for y, p in present if f in p), sum(1 - y for y, p in present if f in p)
        if n0 + n1 >= 2:
            chi[f] = (n1 * t0 - n0 * t1) ** 2 / ((n0 + n1) * (t0 + t1 - n0 - n1 + 1))
    want = sorted(chi, key=lambda f: (-chi[f], f))
    frame = spark.createDataFrame(rows, "toxic int, text string").repartition(3)
    assert toxicity.choose(frame, None, least=2, both=True) == want and toxicity.choose(frame, 3, least=2, both=True) == want[:3]
    share = lambda f, c: sum(f in p for y, p in present if y == c) / (t1 if c else t0)
    assert toxicity.choose(frame, None, least=2) == [f for f in want if share(f, 1) > share(f, 0)]


def test_training_reaches_the_minimum():
    """Against plain gradient descent on the same loss, in dense matrices."""
    rng = np.random.default_rng(14)
    x, d = rng.random((60, 5)) * (rng.random((60, 5)) < 0.5), rng.standard_normal((20, 5)) * (rng.random((20, 5)) < 0.4)
    y = (x @ [2, -1, 0.5, 0, 1] + 0.3 * rng.standard_normal(60) > 0.5).astype(float)
    d = d[(d != 0).any(1)]

    def sparse(m):
        r, c = np.nonzero(m)
        return r, c, m[r, c]

    def loss(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.05 * (w @ w) / 5 + 2.0 * ((d @ w) ** 2).mean()

    w, b = toxicity.train(y, sparse(x), sparse(d), 5, penalty=2.0, steps=3000)
    v, c = np.zeros(5), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ v + c)))
        v, c = v - 0.1 * (x.T @ (p - y) / 60 + 0.1 * v / 5 + 4.0 / len(d) * d.T @ (d @ v)), c - 0.1 * (p - y).mean()
    assert loss(w, b) <= loss(v, c) + 1e-4


def test_scores_of_odd_rows(spark):
    docs, labels = labelled(random.Random(2), 90)
    frame = spark.createDataFrame([(i, t, "x") for i, t in [*docs, (None, "idiot"), (7, None), (7, ""), (7, "\x00 é " * 20_000)]], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.without_toxic(frame, model).columns == frame.columns
    assert {r["doc_id"] for r in toxicity.without_toxic(frame, model).collect()} == {r["doc_id"] for r in rows if r["predicted"] == 0}
    assert toxicity.score(frame.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        toxicity.score(frame, toxicity.fit(frame, some)).count()


def test_no_held_out_row_is_learned_from(spark):
    import zlib

    docs = [(i, "idiot" if zlib.crc32(str(i).encode()) % 5 == 0 else "fine") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t == "idiot")) for i, t in docs], "doc_id long, toxic int")
    assert toxicity.fit(frame, labels).score("idiot") == toxicity.fit(frame, labels).score("unseen")
    assert [r["held_out"] for r in toxicity.score(frame, toxicity.fit(frame, labels)).orderBy("doc_id").collect()] == [t == "idiot" for _, t in docs]


def test_swaps():
    swap = toxicity.swaps((("a", "b", "c"),))
    assert toxicity.swapped(toxicity.counted("A x b"), swap) == {"b": 1, "x": 1, "c": 1} and toxicity.swapped(toxicity.counted("x"), swap) is None


def test_held_out_toxicity(spark):
    toxicity.op2_toxicity(spark, FOLDER).createOrReplaceTempView("scored")
    spark.read.parquet(f"{FOLDER}/labels.parquet").createOrReplaceTempView("labels")
    hit, toxic, wrong, clean = spark.sql("select sum(toxic * predicted), sum(toxic), sum((1 - toxic) * predicted), sum(1 - toxic) from scored join labels using (doc_id) where held_out").first()
    assert hit >= 0.6 * toxic and wrong <= 0.05 * clean


def test_language_backoff():
    model = language_id.Model(["en", "de"], [(0, "en", "the", 9), (0, "de", "der", 9), (0, "de", "the", 1), (3, "de", "sch", 5), (3, "en", "thi", 5), (1, "en", "w", 3), (1, "de", "z", 3)])
    assert model.predict("the the")[0] == "en" and model.predict("der")[0] == "de"
    assert model.predict("fisch")[0] == "de"  # by three letters
    assert model.predict("zq")[0] == "de"  # by one
    assert model.predict("qqq")[1] == 0.5
    assert [model.predict(t) for t in (None, "", "12 %&", "\n")] == [("und", 0.0)] * 4


def test_backoff_equals_brute_force():
    rng = random.Random(16)
    some = lambda n: "".join(rng.choice("abcdéß²語") for _ in range(n))
    rows = [(level, rng.choice(["x", "y", "z"]), g, rng.randrange(1, 9)) for level in range(language_id.LONGEST + 1) for g in {some(level or rng.randrange(1, 6)) for _ in range(25 if level > 1 else 3)}]
    model = language_id.Model(["x", "y", "z"], rows)
    rates = [{} for _ in range(language_id.LONGEST + 1)]
    for level, of in enumerate(rates):
        names = {r[2] for r in rows if r[0] == level}
        for lang in model.langs:
            total = sum(r[3] for r in rows if r[0] == level and r[1] == lang) + 0.5 * (len(names) + 1)
            for g in names:
                of.setdefault(g, []).append(np.log((sum(r[3] for r in rows if r[:3] == (level, lang, g)) + 0.5) / total))

    def word(w):
        if w in rates[0]:
            return np.array(rates[0][w])
        for n in range(language_id.LONGEST, 0, -1):
            known = [rates[n][g] for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if g in rates[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(3)

    texts = [" ".join(some(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["", None, "²", "1 2", some(5000)]
    langs, scores = model.predictions(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0)
            continue
        total = sum(word(w) for w in language_id.words(text))
        assert abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-4 and total[model.langs.index(lang)] > total.max() - 1e-4
    assert model.predictions([])[0] == []


def test_scores_equal_brute_force():
    rng = random.Random(17)
    names = ["alpha", "alph*", "beta", "gamma", "gamm*", "gammar*"]
    model = toxicity.Model(names, np.array([1.0, -0.5, 2.0, 0.3, 0.7, -1.0]), -0.2)
    texts = [" ".join(rng.choice(["Alpha", "alphabet", "beta", "gammarays", "x", "12"]) for _ in range(rng.randrange(12))) for _ in range(100)] + [None, "", "beta " * 5000]
    for text, score in zip(texts, model.scores(texts), strict=True):
        z = model.bias + sum(model.weights[i] * v for i, v in model.values(toxicity.counted(text)).items())
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
    assert len(model.scores([])) == 0 and toxicity.Model([], bias=-40.0).score("x") < 1e-9


def test_long_texts_in_portions(monkeypatch):
    rng = random.Random(18)
    texts = [" ".join(rng.choice(["alpha", "Beta", "ΑΣ", "x"]) for _ in range(n)) for n in (0, 1, 5, 400, 3000)] + [None, "", "y" * 300, " " * 50, "a\xa0b\u2003c" * 40]
    for limit in (1, 7, 64, 10**6):
        found = {}
        for owners, parts in portions(texts, limit):
            assert len(parts) == 1 or sum(map(len, parts)) <= limit
            for i, part in zip(owners, parts, strict=True):
                found[i] = found.get(i, "") + part
        assert found == {i: t for i, t in enumerate(texts) if t}
        assert all([w for _, ps in portions([t], limit) for p in ps for w in language_id.words(p)] == language_id.words(t) for t in texts)
    model = toxicity.Model(["alpha", "beta"], np.array([1.0, -0.5]), 0.1)
    langs = language_id.Model(["p", "q"], [(0, "p", "alpha", 5), (0, "q", "beta", 6), (1, "q", "x", 2)])
    whole = model.scores(texts), langs.predictions(texts)
    for module in (toxicity, language_id):
        monkeypatch.setattr(module, "portions", lambda t: portions(t, 50))
    again = model.scores(texts), langs.predictions(texts)
    assert np.array_equal(whole[0], again[0]) and whole[1][0] == again[1][0] and np.allclose(whole[1][1], again[1][1])


def test_long_words_count_whole(spark):
    model = language_id.Model(["a", "b"], [(1, "a", "x", 10), (1, "b", "y", 10)])
    assert model.predict("x" * 64 + "y" * 200)[0] == "b" and model.predict("y" * 64 + "x" * 200)[0] == "a"
    assert model.predict("x" * 64 + "y" * 300_000)[0] == "b"
    rows = [(i, "q" * 64 + end * 40, lang) for i in range(20) for end, lang in (("xz", "a"), ("yw", "b"))]
    fitted = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.predict("q" * 70 + "yw" * 30)[0] == "b" and fitted.predict("q" * 70 + "xz" * 30)[0] == "a"


def test_language_of_odd_rows(spark):
    docs = [(i, "the cat is here" if i % 2 else "der hund ist da", "en" if i % 2 else "de") for i in range(60)]
    docs += [(60, None, "en"), (61, "", None), (None, "the cat", None), (62, "12", "de"), (1, docs[1][1], "en"), (63, "katze " * 50_000, None)]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, score double")
    model = language_id.fit(frame)
    rows = language_id.predict(frame, model).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in rows if r["doc_id"] is not None and r["doc_id"] < 60)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {60, 61, 62}
    assert language_id.predict(frame.limit(0), model).count() == 0
    assert language_id.predict(frame, language_id.fit(frame.limit(0))).first()["lang_pred"] == "und"


def test_language_counts_equal_brute_force(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "Die", "Katze"]) for _ in range(rng.randrange(6))), rng.choice(["en", "de", None])) for i in range(120)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), model_words=None, model_grams=None, least=1)
    counts = [Counter() for _ in range(language_id.LONGEST + 1)]
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            for w in re.findall(r"[a-z]+", text.lower()):
                counts[0][w, lang] += 1
                for n in range(1, language_id.LONGEST + 1):
                    framed = f" {w} "
                    for at in range(len(framed) - n + 1):
                        counts[n][framed[at : at + n], lang] += 1
    for level, of in enumerate(counts):
        names = {g for g, _ in of}
        assert set(model.levels[level]) == names
        for k, lang in enumerate(model.langs):
            total = sum(n for (_, x), n in of.items() if x == lang) + 0.5 * (len(names) + 1)
            assert all(abs(model.table[model.levels[level][g], k] - np.log((of[g, lang] + 0.5) / total)) < 1e-5 for g in names)
    again = pickle.loads(pickle.dumps(model))
    assert [again.predict(t) for _, t, _ in rows] == [model.predict(t) for _, t, _ in rows]


def test_held_out_languages(spark, tmp_path):
    language_id.op5_language_id(spark, FOLDER).write.parquet(f"{tmp_path}/out")
    right, n = duckdb.sql(f"select count(*) filter (lang = lang_pred), count(*) from '{tmp_path}/out/*.parquet' join '{FOLDER}/documents.parquet' using (doc_id) where held_out and lang is not null").fetchall()[0]
    assert right >= 0.97 * n
