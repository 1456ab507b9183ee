"""Training-data operators against brute force, on small inputs with nulls, ties, copies and odd columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from re import _parser as sre
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, components, decontamination, language, licenses, near_dedup, packing, quality, sharding
from ledgerloom.llm import token_counts, tokenizer, warc

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello, world's end", "<|endoftext|>a <|startoftext|> b", "a\x1cb c\x00d", "ΣΑΣ Σ İstanbul é",
    "漢字かな 한글 1½", "ſ K ß ẞ Ａｂ", "don't I'LL it'd 's", "😀a👩‍👧 x", "word " * 3000, "!!! ... ,,;", "É" * 50,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "x", i % 3) for i, t in enumerate(ODD)] + [(None, "no id", "y", 1), (3, ODD[3], "x", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, length int").repartition(3)


@pytest.fixture(scope="module")
def library():
    return tokenizer.load(tokenizer.read_tokenizer(BPE))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_packing_gives_back_every_id(spark, texts, library):
    rows = packing.pack(texts, BPE, longest=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        assert r["length"] in (1, 2, 4, 8, 16, 32, 64) and r["offset"] == 0 and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], set()).add((r["start"], tuple(r["ids"]), r["doc_tokens"]))
    for i, text in enumerate(ODD):
        want = [*ids(library, text), 2]
        got = [t for _, piece, _ in sorted(by_doc[i]) for t in piece]
        assert got == want and {n for *_, n in by_doc[i]} == {len(want)}
    assert packing.pack(texts.limit(0), BPE).count() == 0


def test_pieces_are_the_binary_digits():
    for total in range(300):
        pieces = packing.pieces_of(total, 32)
        assert sum(n for _, n in pieces) == total
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert len(pieces) == total // 32 + bin(total % 32).count("1")


def test_token_counts_equal_the_library(spark, texts, library):
    rows = token_counts.count_tokens(texts, BPE, limit=20).collect()
    assert len(rows) == texts.count()
    for r in rows:
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]]
        n = len(ids(library, text))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((text or "").encode()), n > 20)


def test_merging_follows_ranks():
    """The heap gives what repeated scans for the lowest rank give."""
    rng = random.Random(3)
    for _ in range(300):
        ranks, results = {}, []
        for _ in range(rng.randrange(1, 12)):
            pair = rng.randrange(3 + len(results)), rng.randrange(3 + len(results))
            key = pair[0] << token_counts.PAIR_BITS | pair[1]
            if key not in ranks:
                ranks[key] = len(results)
                results.append(3 + len(results))
        word = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
        left, made = word[:], 0
        while True:
            found = [
                (ranks[k], i)
                for i in range(len(left) - 1)
                if (k := left[i] << token_counts.PAIR_BITS | left[i + 1]) in ranks
            ]
            if not found:
                break
            rank, i = min(found)
            left[i : i + 2] = [results[rank]]
            made += 1
        assert token_counts.merges_made(word, ranks, results) == made


def test_archive_round_trip(spark, tmp_path):
    long, other = "<p>" + "é" * 60, "x" * 100
    rows = [(5, "u5", long), (2, "u2", long), (9, None, long), (2, "u2", long), (7, "a\r\nb", other), (1, "u", "small"),
            (3, "u", "small"), (4, "u", None), (6, "u", ""), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    assert len(got) == len(rows)
    texts = {r[0]: r[2] or "" for r in rows}
    for r in got:
        payload = texts[r["page_id"]].encode()
        assert bytes(r["payload"]) == payload and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        revisit = payload == long.encode() and r["page_id"] != 2
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == ("2" if revisit else None)
        assert bytes(r["record"]) == bytes(r["header"]) + (b"" if revisit else payload) + b"\r\n\r\n"
        assert bytes(r["header"]).count(b"WARC-Target-URI") == (r["page_id"] != 9)
    empty = str(tmp_path / "b")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damaged_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 200)], "page_id bigint, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    bad = spark.createDataFrame([(hashlib.sha256(b"y" * 200).hexdigest(), b"other")], "payload_digest string, payload binary")
    bad.write.mode("overwrite").parquet(str(tmp_path / "a/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "a")).collect()


def test_nearest_finds_and_ranks(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((400, 8)).astype(np.float32)
    data[100:160] = data[100]  # a group of copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] + [0.0] * 6), (1004, [1.0]), (None, [1.0] * 8), rows[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 400, 20))
    exact = data.astype(np.float64)
    hits = 0
    for q, found in got.items():
        products = (exact * exact[q]).sum(axis=1)
        products[q] = -np.inf
        assert sorted(found) == list(range(1, 21))
        ranked = [found[i] for i in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0])) and all(abs(products[v] - s) < 1e-9 for v, s in ranked)
        hits += len({v for v, _ in ranked} & set(np.lexsort((np.arange(400), -products))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    few = ann.nearest(df.where("vec_id < 5"), F.col("id") % 20 == 0, k=20).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert ann.nearest(df.where("vec_id = 1001"), F.col("id") > 0).count() == 0


def test_probes_come_in_order_of_cost():
    rng = np.random.default_rng(2)
    inside = rng.random(4)
    cells = ann.perturbed(np.zeros(4, dtype=np.int64), inside, 30)
    cost = [sum((inside[i] if d < 0 else 1 - inside[i]) ** 2 for i, d in enumerate(c) if d) for c in cells]
    assert cost == sorted(cost) and len({tuple(c) for c in cells}) == 31
    every = sorted(
        sum((inside[i] if d < 0 else 1 - inside[i]) ** 2 for i, d in enumerate(c) if d)
        for c in itertools.product((-1, 0, 1), repeat=4)
    )
    assert np.allclose(cost, every[:31])


def test_shards_are_exact_and_uniform(spark):
    df = spark.range(4003).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("value"))
    df = df.union(df.where("doc_id < 3")).union(spark.createDataFrame([(None, None)], "doc_id bigint, value bigint"))
    rows = sharding.shard_rows(df, ["doc_id", "value"], shards=8, block_rows=300).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == 4007 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    # Counts of a class of rows per shard stay near their expectation, and so does their order.
    per = Counter(r["shard"] for r in rows if r["value"] == 3)
    assert all(40 <= per[s] <= 105 for s in range(8))
    slots = [r["slot"] for r in rows if r["value"] == 3]
    assert 215 <= np.mean(slots) <= 285
    assert sharding.shard_rows(df.limit(0), ["doc_id"]).count() == 0


def test_sharding_keeps_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BLOCKS", 3)
    names = ["doc_id", "_block", "_first", "_second", "_place", "_sub", "_start", "_within", "_cuts", "_row", "count"]
    df = spark.createDataFrame([tuple(range(i, i + len(names))) for i in range(100)], ", ".join(f"{n} int" for n in names))
    rows = sharding.shard_rows(df, ["doc_id"], shards=4, block_rows=5).collect()
    assert sorted(tuple(r)[:-2] for r in rows) == sorted(map(tuple, df.collect()))
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(4) for i in range(25)]


def test_communication_matrix_keeps_sums():
    matrix = sharding.communication_matrix([10, 0, 7, 30], [16, 16, 15], seed=1)
    assert matrix.sum(axis=1).tolist() == [10, 0, 7, 30] and matrix.sum(axis=0).tolist() == [16, 16, 15]
    big = sharding.take_places(np.array([10**12, 0, 10**12]), 5000, np.random.default_rng(1))
    assert big.sum() == 5000 and big[1] == 0 and 2200 < big[0] < 2800


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    want = classes(links, {n for a, b in links if a != b for n in (a, b)})
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = base[:]
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [docs[0].upper(), docs[0].replace(" ", "\t\n"), "", None, " ", "one", "One", "two words", "É é"]
    rows = [(i, t, "c", i) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows + [(None, docs[0], "c", 0), rows[4]], "doc_id bigint, text string, component_id string, n int")

    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(size, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets = [shingles(t) for t in docs]
    links = [
        (i, j)
        for i, j in itertools.combinations(range(len(docs)), 2)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = classes(links, range(len(docs)))
    got = near_dedup.near_duplicates(df, size, percent).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["n_shingles"] == len(sets[0])
            continue
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_lose_no_link():
    """Members of a block in different components are linked exactly where their sets say so."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < 0.97], rng.integers(0, 2**62, 4).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**62, 50).astype(np.uint64)) for _ in range(5)]
    import pyarrow as pa

    low = (near_dedup.signatures(sets) & np.uint32(255)).astype(np.uint8)
    table = pa.table(
        {
            "doc": list(range(45)), "root": list(range(45)), "low": pa.array([v.tobytes() for v in low], pa.binary()),
            "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            **{n: np.zeros(45, dtype=np.int32) for n in ("c", "d", "i", "j", "side")},
        }
    )
    got = near_dedup.linking(0.7, 85)(table, np.array([0]))
    links = [
        (i, j) for i, j in itertools.combinations(range(45), 2)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
    ]
    found = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert set(found) <= set(links) and len(found) < 45
    assert classes(found, range(45)) == classes(links, range(45))


def test_every_pair_of_like_size_meets_once(spark, monkeypatch):
    """Members of a bucket meet in one cell if their sizes allow a link, and never twice."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(7)
    sizes = [rng.choice([1, 2, 10, 11, 12, 13, 40, 47, 55, 300, 301, 340, 1000]) for _ in range(64)]
    rows = [(band, i, i, n) for band in (1, 2) for i, n in enumerate(sizes)]
    for percent in (80, 85, 100):
        df = spark.createDataFrame(rows, "band bigint, doc bigint, root bigint, n_shingles bigint")
        met = Counter()
        held = {}
        for r in near_dedup.cells(df, percent).collect():
            held.setdefault((r["band"], r["c"], r["d"], r["i"], r["j"]), []).append((r["side"], r["doc"]))
        for (band, c, d, i, j), members in held.items():
            for x, y in itertools.combinations(members, 2):
                if (c, i) == (d, j) or x[0] != y[0]:
                    met[band, *sorted((x[1], y[1]))] += 1
        assert max(met.values()) == 1 and max(map(len, held.values())) < 30
        for x, y in itertools.combinations(range(64), 2):
            if 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y]):
                assert met[1, x, y] == met[2, x, y] == 1
    sets = [np.array([1, 2, 3, 4, 5 + i], dtype=np.uint64) for i in range(4)]
    low = np.zeros((4, near_dedup.HASHES), dtype=np.uint8)
    table = pa.table(
        {"doc": [0, 1, 2, 3], "root": [0, 1, 2, 3], "low": pa.array([v.tobytes() for v in low], pa.binary()),
         "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), "side": np.array([0, 0, 1, 1], dtype=np.int32),
         **{n: np.full(4, v, dtype=np.int32) for n, v in (("c", 3), ("d", 4), ("i", 0), ("j", 0))}}
    )
    found = near_dedup.linking(0.5, 60)(table, np.array([0]))
    assert {(a < 2, b < 2) for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)} == {(True, False)}


def test_language(spark):
    en, de, ru = "the house of the king is the best thing", "das haus und der könig sind nicht mehr da", "это дом короля и всё хорошо"
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 8)]
    docs = spark.createDataFrame(rows + [(90, None, "en"), (91, "the", None)], "doc_id bigint, text string, lang string")
    model = language.fit_languages(docs, F.lit(True))
    asked = spark.createDataFrame(
        [(1, "the king of the house"), (2, "der könig und das haus"), (3, "дом короля"), (4, None), (5, "123 !!"), (6, "漢字"),
         (7, f"{en} {en} {de} {de} {de}"), (None, "the thing is"), (1, "the king of the house")],
        "doc_id bigint, text string",
    ).withColumn("lang_pred", F.lit("z"))
    got = [r.asDict() for r in language.identify(asked, model).collect()]
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 9
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7, None)] == ["en", "de", "ru", "und", "und", "de", "en"]
    assert by_id[4]["score"] == by_id[5]["score"] == 0 and by_id[1]["score"] == 1
    spans = by_id[7]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and spans[1]["first"] == 18
    none = language.fit_languages(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(asked, none).collect()} == {"und"}


def test_language_of_scripts_that_no_language_uses(spark, monkeypatch):
    import corpus_pipeline

    en, de = "the house of the king is the best thing", "das haus und der könig sind nicht mehr da"
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_languages(docs, F.lit(True))
    texts = [
        (20, "漢字", "de", 0), (21, "это дом короля", "de", 0), (22, "king 漢字漢字漢字", "en", 0.4), (23, "the king 漢字", "en", 7 / 9),
        (24, "die漢字漢字漢字漢字 haus", "de", 7 / 15), (25, "the king — “best” …", "en", 1), (26, "漢字 123", "de", 0), (27, "123 ?", "und", 0), (28, None, "und", 0),
    ]
    asked = spark.createDataFrame([(i, t, None) for i, t, *_ in texts], docs.schema)
    got = {r["doc_id"]: r for r in language.identify(asked, model).collect()}
    for i, text, label, score in texts:
        assert (got[i]["lang_pred"], bool(got[i]["spans"])) == (label, label != "und"), text
        assert got[i]["score"] == pytest.approx(score), text
    monkeypatch.setattr(language, "fit_languages", lambda *_: model)
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, asked, "").collect()} == {23, 25}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(6)
    lengths = np.array([1, 2, 4, 5, 5])
    emit = rng.normal(size=(5, 3, 5)).astype(np.float32)
    paths = language.best_paths(emit.copy(), lengths, 0.8)
    for d, n in enumerate(lengths):
        worth = lambda p: sum(emit[t, label, d] for t, label in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(worth, itertools.product(range(3), repeat=int(n))))
        assert abs(worth(paths[:n, d].tolist()) - best) < 1e-5


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("stone river quiet morning walk light".split()) for _ in range(30)).capitalize() + "."
    bad = lambda: " ".join(rng.choice("BUY NOW!! WIN!! $$$ CLICK!!".split()) for _ in range(30))
    rows = [(i, good() if i % 2 else bad(), "s") for i in range(200)] + [(500, None, "s"), (501, "", "s"), (None, good(), "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (5, 7)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels, F.lit(True), sample_rows=80)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert len(got) == 203 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == i % 2 for i in range(200))
    assert got[500]["score"] == got[501]["score"] == pytest.approx(model.prior)
    none = quality.fit_quality(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 10, 14]))) for _ in range(12)] + [None, "", "?!"]
    docs = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            words[rng.randrange(len(words) + 1) : 0] = (rng.choice(items) or "").upper().split()
        docs.append(", ".join(words))
    docs += [None, "", items[3], "x-" + (items[4] or "")]
    benchmark = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)] + [(None, "v1 v2")], "item_id string, text string")
    rows = [(i, t, 1) for i, t in enumerate(docs)] + [(None, docs[0], 1), (2, docs[2], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, items int")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    got = decontamination.decontaminate(df, benchmark).collect()
    assert len(got) == len(rows)
    for r in got:
        words, hit, names = split(docs[r["doc_id"] or 0]), set(), set()
        for i, item in enumerate(items):
            w = split(item)
            size = min(10, len(w))
            windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
            for k in range(len(words) - size + 1 if w else 0):
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    names.add(f"i{i}")
        listed = ",".join(sorted(names))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert not any(r["contaminated"] for r in decontamination.decontaminate(df, benchmark.limit(0)).collect())
    assert decontamination.decontaminate(df.limit(0), benchmark).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License. mit license MIT-LICENSE", 3, [3, 4, 6], "mit"),
        (2, "Licensed under CC BY-NC 4.0.", 1, [2], "cc-by,cc-by-nc-4.0"),
        (3, "GNU General Public License, version 3", 1, [0], "gpl,gpl-3.0"),
        (4, None, 0, [], ""),
        (5, "nothing here", 0, [], ""),
        (6, "SPDX-License-Identifier: Apache-2.0", 0, [], "apache-2.0"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id bigint, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, text, n, _, labels in rows:
        assert (got[i]["n_base"], got[i]["labels"]) == (n, labels), text
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] > 0) == bool(labels)
    assert (got[1]["first_word"], got[1]["last_word"], got[4]["first_word"]) == (3, 7, None)
    assert len(licenses.license_rules()) > 200 and licenses.scan_licenses(df.limit(0)).count() == 0


def variants(parsed):
    """Texts that a parsed pattern matches: every alternative, optional parts with and without."""
    out = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            more = [chr(arg)]
        elif op is sre.ANY:
            more = ["x"]
        elif op is sre.IN:
            more = [chr(c) for kind, c in arg if kind is sre.LITERAL] or ["1"]
        elif op is sre.SUBPATTERN:
            more = variants(arg[3])
        elif op is sre.BRANCH:
            more = [t for branch in arg[1] for t in variants(branch)]
        else:
            assert op is sre.MAX_REPEAT
            more = [t * n for n in {arg[0], max(arg[0], 1)} for t in variants(arg[2])]
        out = [a + b for a in out for b in more]
    return out


def test_license_keywords_stand_in_every_match():
    rules = licenses.license_rules()
    for rule in rules:
        texts = variants(sre.parse(rule.pattern))
        alone = licenses.Scanner([rule])
        lost = [t for t in texts if not alone.rule_matches(f" {t} ".encode())]
        assert texts and not lost, (rule.label, lost[:3])
    scanner = licenses.Scanner(rules)
    for text, label in (
        ("WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "warranty"),
        ("CC-0 1.0", "cc-zero"),
        ("CC 0", "cc-zero"),
        ("GNU Library General Public License", "lgpl"),
        ("Q Public License 1.0", "qpl-1.0"),
        ("Open RAIL-M", "openrail-m"),
        ("no copyright is asserted", "public-domain"),
    ):
        assert [d.label for d in scanner.scan(f"it says {text} here")[2]] == [label], text


def test_license_addresses_and_versions():
    scanner = licenses.Scanner(licenses.license_rules())
    labels = lambda text: [d.label for d in scanner.scan(f"see {text} now")[2]]
    for kind, *_ in licenses.CC_ELEMENTS:
        for version in licenses.CC_VERSIONS:
            number = version.replace(" ", ".")
            for address in (f"https://creativecommons.org/licenses/{kind}/{number}/", f"Creative Commons.org/licenses/{kind}/{number}"):
                assert labels(address) == [f"cc-{kind}-{number}"], address
    for name, label in (
        ("GNU Affero General Public License", "agpl-3.0"), ("Affero General Public License", "agpl-1.0"),
        ("GNU Lesser General Public License", "lgpl-3.0"), ("GNU Lesser General Public License", "lgpl-2.1"),
        ("GNU Library General Public License", "lgpl-2.0"), ("GNU General Public License", "gpl-3.0"),
        ("GNU General Public License", "gpl-2.0"), ("GNU General Public License", "gpl-1.0"),
        ("GNU Free Documentation License", "gfdl-1.3"), ("GNU Free Documentation License", "gfdl-1.2"),
        ("GNU Free Documentation License", "gfdl-1.1"), ("Apache License", "apache-2.0"), ("Apache Software License", "apache-1.1"),
        ("Apache License", "apache-1.0"), ("Mozilla Public License", "mpl-2.0"), ("Mozilla Public License", "mpl-1.1"),
        ("Mozilla Public License", "mpl-1.0"), ("Eclipse Public License", "epl-2.0"), ("Eclipse Public License", "epl-1.0"),
        ("Eclipse Distribution License", "edl-1.0"), ("Common Public License", "cpl-1.0"), ("IBM Public License", "ipl-1.0"),
        ("Common Development and Distribution License", "cddl-1.1"), ("Common Development and Distribution License", "cddl-1.0"),
        ("European Union Public Licence", "eupl-1.2"), ("European Union Public License", "eupl-1.1"),
        ("Artistic License", "artistic-2.0"), ("Artistic License", "artistic-1.0"), ("Boost Software License", "boost-1.0"),
        ("Business Source License", "bsl-1.1"), ("Python License", "python-2.0"), ("PSF License", "psf-2.0"),
        ("PHP License", "php-3.01"), ("PHP License", "php-3.0"), ("Academic Free License", "afl-3.0"),
        ("Open Software License", "osl-3.0"), ("Universal Permissive License", "upl-1.0"), ("Q Public License", "qpl-1.0"),
        ("SIL Open Font License", "ofl-1.1"), ("Open Database License", "odbl-1.0"), ("Open Government Licence", "ogl-uk-3.0"),
        ("Open Government Licence", "ogl-uk-2.0"), ("CeCILL", "cecill-2.1"), ("Server Side Public License", "sspl-1.0"),
        ("Elastic License", "elastic-2.0"),
    ):
        number = label.rsplit("-", 1)[1]
        for form in (f"v{number}", f"v {number}", f"version {number}", f"V{number}"):
            assert labels(f"{name} {form}") == [label], (name, form)
    assert labels("Apache License v2") == ["apache-2.0"] and labels("GNU General Public License v3") == ["gpl-3.0"]
    assert labels("the General Public License v2 with Classpath exception") == ["gpl-classpath"]
    assert labels("Server Side Public License") == ["sspl-1.0"]
    # Whatever else a pattern allows: "v" may stand before the number or be a word of its own.
    for rule in licenses.license_rules():
        assert "(?:version |v )" not in rule.pattern, rule.label


def test_suppression():
    d = licenses.Detection
    inside, outer, better, apart = d("a", 1, 2, 3), d("b", 9, 1, 4), d("c", 5, 4, 6), d("d", 7, 20, 21)
    assert [x.label for x in licenses.suppressed([inside, outer])] == ["b"]
    assert [x.label for x in licenses.suppressed([outer, better, apart])] == ["c", "d"]
    assert [x.label for x in licenses.suppressed([d("x", 2, 1, 4), outer])] == ["x"]


def test_pipeline_keeps_a_row_per_distinct_text(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [
        (5, a, 0), (5, b, 1), (5, b, 2), (3, f"{a} more", 3), (None, c, 4), (None, c, 5), (None, f"{b} end", 6),
        (7, "", 7), (7, "", 8), (8, "", 9), (None, "", 10), (None, "", 11), (None, None, 12), (None, None, 13), (7, c, 14),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int").repartition(3)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(3, f"{a} more"), (5, b), (7, c), (7, ""), (8, ""), (None, ""), (None, None)])


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline

    kept = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        out = stage(spark, kept.withColumn("score", F.lit("s")), "/root/testdata/sf0.001").drop("score")
        assert out.columns == kept.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before and len(after) == kept.count() and len(after) > 0.5 * len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == after
