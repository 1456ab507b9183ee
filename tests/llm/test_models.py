"""Classifiers, tokenizer files and vector searches against plain versions, with ties, long texts and bounded memory."""

from __future__ import annotations

import json
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, language, packing, quality, token_counts, tokenizer

ROOT = Path(__file__).resolve().parents[2]
EMBEDDINGS = "/root/testdata/sf0.01/embeddings.parquet"


def test_scores_of_doubles_are_exact(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(120, 5))
    data[7] = data[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    rows = ann.nearest(df, F.col("id") % 20 == 0, k=5).collect()
    assert len(rows) == 30
    for r in rows:
        assert r["score"] == (data[r["query_id"]] * data[r["vec_id"]]).sum()
    one = spark.createDataFrame([(0, [1.0]), (1, [0.17])], df.schema)
    assert [r["score"] for r in ann.nearest(one, F.col("id") == 0, k=5).collect()] == [0.17]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet(EMBEDDINGS)
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    data = np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        products = data @ data[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -products)) if ids[i] != q][:20]
        assert len(got) == 20
        hits += len(got & set(order))
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(found)


def test_index_gets_more_selective_with_the_table():
    """The share of the table that a question visits falls as the table grows."""
    shares = []
    for n in (500, 8000):
        rng = np.random.default_rng(2)
        data = rng.normal(size=(n, 6)).astype(np.float32)
        products = data[:64].astype(np.float64) @ data.T.astype(np.float64)
        products[np.arange(64), np.arange(64)] = -np.inf
        answers = [data[np.argsort(-p)[:10]] for p in products]
        longest = float(np.linalg.norm(data, axis=1).max())
        index = ann.fit_index(data[:4096], data[:64], answers, longest, 6, 24, 0.95, 1)
        assert index.recall >= 0.95
        keys = index.keys(data)
        shares.append(np.mean([np.isin(keys, p).any(axis=1).mean() for p in index.probe_keys(data[:64])]))
    assert shares[1] < 0.8 * shares[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_file(name):
    content = tokenizer.read_tokenizer(public_tokenizers.path(name))
    spec = json.loads(content)
    assert tokenizer.splits_here(spec) == (name == "word_bpe_49k.json") and tokenizer.merges_here(spec)
    texts = ["Hello  world's", "", "a<|endoftext|>b", "É İ ß ſ 漢字 x\n\ny", "don't 12 345", "  lead", "a" * 300]
    library = tokenizer.load(content)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.TextIds(content).of(texts)] == want
    assert token_counts.TextCounts(content).of(texts) == list(map(len, want))


def test_changed_rules_go_to_the_library():
    spec = json.loads(tokenizer.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["Hello World's #tag aaa", "a [X] b", "a<|endoftext|>b"]
    for change in ("case", "special", "prefix"):
        other = json.loads(json.dumps(spec))
        if change == "case":
            other["normalizer"] = {"type": "NFC"}
        elif change == "special":
            other["added_tokens"].append({**other["added_tokens"][0], "id": 5, "content": "[X]"})
            other["model"]["vocab"] = {("[X]" if i == 5 else t): i for t, i in other["model"]["vocab"].items()}
            other["model"]["merges"] = []
        else:
            other["pre_tokenizer"]["pretokenizers"][-1]["add_prefix_space"] = True
        content = json.dumps(other)
        assert not tokenizer.splits_here(other)
        library = tokenizer.load(content)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in packing.TextIds(content).of(texts)] == want, change
        assert token_counts.TextCounts(content).of(texts) == list(map(len, want)), change


def plain_language(train, texts, penalty=8.0):
    """Letter-run scores, script gates and the best path, one word and one cell at a time."""
    mask = (1 << 64) - 1

    def runs(word):
        padded = [1, *map(ord, word), 1]
        for size in (2, 3):
            for i in range(len(padded) - size + 1):
                mixed = size
                for c in padded[i : i + size]:
                    mixed = ((mixed ^ c) * 0x9E3779B97F4A7C15) & mask
                    mixed ^= mixed >> 31
                yield mixed % language.FEATURES

    script = lambda c: next(n for s, n in reversed(language.SCRIPT_STARTS) if s <= ord(c))
    names = sorted({lang for _, lang in train})
    counts = {n: Counter() for n in names}
    scripts = {n: Counter() for n in names}
    for text, lang in set(train):
        for w in text.lower().split():
            letters = sum(map(str.isalpha, w))
            if letters:
                counts[lang].update(runs(w))
                scripts[lang][script(next(c for c in w if c.isalpha()))] += letters
    uses = {n: {s for s, k in scripts[n].items() if k >= 0.005 * sum(scripts[n].values())} for n in names}
    used = set().union(*uses.values())
    size = {n: sum(counts[n].values()) + 0.5 * language.FEATURES for n in names}
    out = []
    for text in texts:
        words = (text or "").lower().split()
        rows, weights = [], []
        for w in words:
            first = next((c for c in w if c.isalpha()), None)
            if first is None or script(first) not in used:
                rows.append([0.0] * len(names))
            else:
                score = [sum(np.log((counts[n][f] + 0.5) / size[n]) for f in runs(w)) for n in names]
                rows.append([max(s - max(score), -50.0) if script(first) in uses[n] else -50.0 for s, n in zip(score, names)])
            weights.append(sum(c.isalpha() and script(c) in used for c in w))
        total = sum(c.isalpha() for w in words for c in w)
        if not total:
            out.append(("und", 0.0))
            continue
        value, back = rows[0], []
        for row in rows[1:]:
            top = max(value)
            step = [i if value[i] >= top - penalty else value.index(top) for i in range(len(names))]
            value = [max(value[i], top - penalty) + row[i] for i in range(len(names))]
            back.append(step)
        label = value.index(max(value))
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        weight = [0] * len(names)
        for label, w in zip(reversed(path), weights):
            weight[label] += w
        best = weight.index(max(weight))
        out.append((names[best], weight[best] / total))
    return out


def test_language_as_a_whole(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "sh"], "bb": ["der", "ung", "sch"], "cc": ["дом", "ко", "ра"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(n))
    train = [(text(lang, 30), lang) for lang in parts for _ in range(6)]
    asked = [text(rng.choice(list(parts)), rng.randrange(1, 25)) + " " + text(rng.choice(list(parts)), rng.randrange(1, 25)) for _ in range(60)]
    asked += [None, "", "12 !", "漢字 漢", "漢字 the", "the", "ßß", text("bb", 40_000), asked[0], asked[0]]
    docs = spark.createDataFrame([*train, *train[:5]], "text string, lang string")
    model = language.fit_languages(docs, F.lit(True))
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(asked)], "doc_id bigint, text string, spans int, lang_pred int")
    got = {r["doc_id"]: r for r in language.identify(table, model, with_spans=False).collect()}
    assert model.languages == list(parts)
    for i, (label, score) in enumerate(plain_language(train, asked)):
        assert (got[i]["lang_pred"], got[i]["score"]) == (label, pytest.approx(score)), asked[i]


def test_language_sample_counts_a_text_once(spark):
    docs = spark.createDataFrame([(f"word{i} the", "a") for i in range(40)] + [("copy of it", "a")] * 3000 + [("das", "b")], "text string, lang string")
    small = language.fit_languages(docs, F.lit(True), sample_docs=10)
    again = language.fit_languages(docs.repartition(6).union(docs), F.lit(True), sample_docs=10)
    assert np.array_equal(small.log, again.log) and small.languages == ["a", "b"]
    assert language.fit_languages(docs, F.lit(True), most_languages=1).languages == ["a"]


def test_votes_of_all_labelled_vectors(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "!!", "$", "."]) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "漢字 " * 50_000), (902, rows[3][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int("!!" in t)) for i, t in rows[:200]], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels, F.lit(True), dimensions=12, neighbours=9)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    vectors, featurizer = model.vectors.astype(np.float64), quality.Featurizer()
    for i, text in [*rows, (901, "漢字 " * 50_000)]:
        near = vectors @ model.latent(featurizer.of([text]))[0].astype(np.float64)
        order = np.lexsort((np.arange(len(near)), -near))
        if abs(near[order[8]] - near[order[9]]) < 1e-5:
            continue
        weight = np.maximum(near[order[:9]], 0) ** 4
        want = (weight * model.labels[order[:9]]).sum() / weight.sum() if weight.sum() > 1e-9 else model.prior
        assert got[i] == pytest.approx(want, abs=1e-4)
    assert got[900] == pytest.approx(model.prior) and got[902] == got[3]


def test_quality_model_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i % 50, f"Text {i % 50} of copy {i // 50}.") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    one = quality.fit_quality(docs, labels, F.lit(True), sample_rows=60)
    two = quality.fit_quality(docs.repartition(7), labels.repartition(3), F.lit(True), sample_rows=60)
    assert len(one.labels) == 60 and one.prior == two.prior and np.array_equal(one.vectors, two.vectors)


def test_memory_of_short_texts():
    """Ten thousand one-line texts cost a worker little beyond its input."""
    # A model of few rows is made and then repeated, so that the fit's own peak does not hide that of scoring.
    script = """
import resource
import numpy as np, pyarrow as pa
from ledgerloom.llm import quality
from ledgerloom.llm.common import text_slices
rng = np.random.default_rng(1)
model = quality.QualityModel(rng.random((60, quality.FEATURES), dtype=np.float32), rng.integers(0, 2, 60), 48, 15)
model.vectors, model.labels = np.tile(model.vectors, (50, 1)), np.tile(model.labels, 50)
batch = pa.RecordBatch.from_arrays([pa.array([f"line {i} of text {i * 7}" for i in range(10_000)])], names=["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
featurizer = quality.Featurizer()
for part in text_slices(batch, 0):
    model.score(featurizer.of(part.column(0).to_pylist()))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=ROOT, timeout=120, check=True)
    assert int(out.stdout) < 60_000
