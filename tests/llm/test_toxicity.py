"""Toxicity by compression lengths: accuracy on texts not learned from, the lengths themselves, odd input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.common import labelled_sample
from ledgerloom.llm.queries import fold

INSULTS = ["grobnak", "fleezit", "wurmsod", "pilfrot"]


def prose(rng, bad=0.0, words=60):
    parts = ["the", "ar", "ten", "lo", "sha", "ion", "er", "and", "ing", "ou", "re", "st"]
    out = []
    for _ in range(words):
        insult = rng.random() < bad
        out.append(rng.choice(INSULTS) + rng.choice(["", "s", "ly"]) if insult else "".join(rng.choices(parts, k=rng.randrange(1, 4))))
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 0.06 if i % 4 == 0 else 0.0, rng.randrange(40, 200)), int(i % 4 == 0)) for i in range(700)]
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1) for i, t, _ in rows], "doc_id bigint, text string, lang string, score double, mark int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id bigint, toxic int, quality int")
    return docs, labels


def test_texts_not_learned_from(corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels, fold(5) != 0)
    found = toxicity.score_toxicity(docs, model, keep=("lang",)).join(labels, "doc_id").where(fold(5) == 0)
    rows = found.collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert len(rows) > 100 and np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["lang"] == "en" for r in rows)
    # Other copies of the fit, and other partitions, give the same model.
    again = toxicity.fit_toxicity(docs.repartition(7), labels.union(labels).repartition(3), fold(5) != 0)
    assert again.dictionaries == model.dictionaries and again.threshold == model.threshold


def test_odd_texts(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels, fold(5) != 0)
    clean, bad = prose(random.Random(1), 0, 30_000), prose(random.Random(2), 0.06, 30_000)
    odd = [None, "", "   \n", "漢字" * 400_000, clean, bad, "grobnak " * 40, "x" * 3_000_000, "\x00é😀", bad]
    table = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(odd)] + [(None, "the", "k", 3)], "doc_id bigint, text string, score string, predicted int")
    got = {r[0]: r for r in toxicity.score_toxicity(table, model).collect()}
    assert len(got) == len(odd) + 1 and all(0 <= r["score"] <= 1 for r in got.values())
    predicted = [got[i]["predicted"] for i in range(len(odd))]
    assert predicted == [0, 0, 0, 0, 0, 1, 1, 0, 0, 1] and got[0]["score"] == got[1]["score"]
    assert toxicity.score_toxicity(table.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True))
    one_kind = toxicity.fit_toxicity(docs, labels.where("toxic = 1"), F.lit(True))
    assert {r["predicted"] for m in (none, one_kind) for r in toxicity.score_toxicity(table, m).collect()} == {0}
    same = toxicity.fit_toxicity(docs.withColumn("text", F.lit("one text")), labels, F.lit(True))
    assert {r["predicted"] for r in toxicity.score_toxicity(table, same).collect()} == {0}


def test_windows_cover_every_word():
    rng = random.Random(5)
    for words in (0, 1, 2, 7, 8, 9, 10, 31):
        data = prose(rng, 0, words).encode()
        seen = [bytes(w).split() for w in toxicity.windows(data)]
        assert all(len(w) <= toxicity.WINDOW for w in seen)
        assert [w for i, s in enumerate(seen) for w in (s if i == len(seen) - 1 else s[: toxicity.STRIDE])] == data.split()
    assert {len(w) for w in toxicity.windows(b"y" * 100)} == {105}


def test_levels_are_differences_of_lengths(corpus):
    docs, labels = corpus
    texts = {y: [r["text"] for r in docs.join(labels, "doc_id").where(F.col("toxic") == y).orderBy("doc_id").collect()] for y in (0, 1)}
    model = toxicity.ToxicityModel(texts[1], texts[0])
    plain, toxic = (toxicity.compressor(d) for d in model.dictionaries)
    text = texts[1][3]
    saved = [len(plain(w)) - len(toxic(w)) for w in map(bytes, toxicity.windows(toxicity.normal(text)))]
    want = [sum(max(0, min(s, 4)) == level for s in saved) for level in range(5)]
    assert model.levels(text).tolist() == want and sum(want[1:]) > 0
    over = float(np.array(want) @ model.weights) - model.threshold
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(over, -30, 30))), abs=1e-12)


def test_sample_is_of_distinct_texts(spark):
    """Copies of a text and of an id do not change which texts are chosen."""
    docs = spark.createDataFrame([(i % 50, f"text {i % 60}") for i in range(3000)] + [(None, "z")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(500)] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")

    def chosen(d, l):
        return sorted(map(tuple, labelled_sample(d, l, F.lit(True), {1: 7, 0: 9}, "doc_id", "text", "toxic").collect()))

    want = chosen(docs, labels)
    assert len([r for r in want if r[0] == 1]) == 7 and len(want) == 16
    assert chosen(docs.repartition(9), labels.repartition(4)) == want == chosen(docs.union(docs), labels.distinct())
