"""License scans against a plain word-by-word model, on long texts, ties, nulls and repeated rows."""

from __future__ import annotations

import itertools
import random
import re

from ledgerloom.llm import licenses
from ledgerloom.llm.licenses import Detection

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def base(text):
    """Starts and labels of all places, each word looked at."""
    mine = words(text)
    out = []
    for phrase, label in PHRASES:
        want = phrase.split()
        out += [(i, label) for i in range(len(mine) - len(want) + 1) if mine[i : i + len(want)] == want]
    return len(mine), out


def plain_suppressed(found):
    """Strictly contained intervals go; then by priority, place and order each one that overlaps nothing kept."""
    free = [
        d for i, d in enumerate(found)
        if not any(
            (e.first <= d.first and d.last <= e.last and (e.first, e.last) != (d.first, d.last))
            or ((e.first, e.last) == (d.first, d.last) and (e.priority, j) < (d.priority, i))
            for j, e in enumerate(found) if j != i
        )
    ]
    kept = []
    for d in sorted(free, key=lambda d: (d.priority, d.first)):
        if all(d.last < k.first or k.last < d.first for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: d.first)


def test_base_places_equal_a_plain_count(spark):
    rng = random.Random(4)
    pieces = ["GNU", "general", "Public", "License", "apache", "license", "CC", "BY", "mit", "É", "漢字", "x1", "-", "\n", "…", "cc by", "MIT-License"]
    texts = [None, "", "!?", "mit license " * 40_000, "word " * 100_000 + "Apache License"]
    texts += [rng.choice([" ", ", ", "\t"]).join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(150)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[9], 1, "x"), (9, texts[9], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, labels string").repartition(4)
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, places = base(texts[9 if r["doc_id"] is None else r["doc_id"]])
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_suppression_equals_its_rule():
    rng = random.Random(5)
    for _ in range(3000):
        found = []
        for _ in range(rng.randrange(7)):
            first = rng.randrange(12)
            found.append(Detection(f"l{rng.randrange(5)}", rng.randrange(3), first, first + rng.randrange(6)))
        got = licenses.suppressed(found)
        want = plain_suppressed(found)
        assert [(d.first, d.last, d.priority) for d in got] == [(d.first, d.last, d.priority) for d in want]
        assert all(a.last < b.first for a, b in itertools.pairwise(got))
