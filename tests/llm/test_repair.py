"""Conversation repair against the least of all edit sequences, on odd and on random conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from ledgerloom.llm import repair
from ledgerloom.llm.repair import Repair
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key int, copies int, digest string, mirror string"
LEGAL = re.compile("(s?(ua)+)?")


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(repair.SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by trying every edit of every turn with up to two insertions between."""
    insert = [("I", 5, ("user", "")), ("I", 5, ("assistant", ""))]
    gaps = [()] + [(a,) for a in insert] + [(a, b) for a in insert for b in insert]
    best = None
    choices = []
    for (_, role, text), fault in zip(turns, faults(turns)):
        more = 5 if fault == "truncated" else 0
        some = [("D", 2, None)]
        if fault in ("none", "truncated"):
            some += [("K", more, (role, text))] + [("R", 1 + more, (r, text)) for r in ("user", "assistant")]
        choices += [gaps, [(c,) for c in some]]
    for way in itertools.product(*choices, gaps):
        edits = [e for part in way for e in part]
        if LEGAL.fullmatch("".join(t[0][:1] or " " for _, _, t in edits if t)):
            found = (sum(c for _, c, _ in edits), "".join(e for e, _, _ in edits), [t for _, _, t in edits if t])
            best = found if best is None or found[:2] < best[:2] else best
    return best


def wanted(rows):
    turns = sorted(
        ((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).digest()),
    )
    found = faults(turns)
    given = [t for t, _, _ in turns if t is not None]
    cost, audit, whole = cheapest(turns)
    return (
        max(given) - min(given) + 1 - len(set(given)) if given else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in whole).encode()).hexdigest(),
    ), whole


def conversations():
    rng = random.Random(4)
    texts = ["Yes.", "no", "Why?", "", " \t", None, "Well!\n", "…"]
    out = {
        None: [(0, "user", "Hi."), (1, "assistant", "Yo.")],
        1: [(None, None, None), (None, "user", "a."), (3, "user", "a."), (3, "user", "a."), (7, "assistant", "b")],
        2: [(5, "system", "s."), (6, "system", "s2.")],
        3: [(0, "", "x."), (1, "tool", "y."), (1, "unit", "z.")],
    }
    for i in range(4, 60):
        n = rng.randrange(1, 4)
        out[i] = [
            (rng.choice([None, 0, 1, 2, 5]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(texts)) for _ in range(n)
        ]
    return out


def test_repair_is_the_cheapest(spark):
    given = conversations()
    rows = [(c, *t, 1, 2, "x", "y") for c, turns in given.items() for t in turns]
    random.Random(1).shuffle(rows)
    rows += [(77, 3, "user", "gone.", 1, 0, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("many", F.when(F.col("copies") == 0, 0).otherwise(1))
    fixed = Repair(table, copies=F.col("many"))
    got = {r["conv_id"]: tuple(r)[1:] for r in fixed.summary().collect()}
    turns = {}
    for r in fixed.turns().orderBy("position").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {*given, 77}
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv, some in given.items():
        want, whole = wanted(some)
        assert got[conv] == want, conv
        assert turns.get(conv, []) == whole


def test_long_conversation_is_cut_and_joined(spark):
    """A conversation in many tasks, with copies and runs of equal turns, reads as in one."""
    rows = [(9, i // 3, ("user", "assistant", "system")[i % 7 % 3], f"t{i % 50}" + "." * (i % 4 > 0), 0, 1, None, None) for i in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    one = Repair(table.coalesce(1)).summary().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = Repair(table).summary().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one == many and one[0]["gaps"] == 0 and one[0]["duplicate"] > 2000


def test_suffixes_are_shared():
    automaton = repair.Suffixes()
    rng = random.Random(2)
    signatures = sorted({"".join(rng.choice("AEIL") for _ in range(rng.randrange(9))) for _ in range(400)})
    for mirror in signatures:
        assert automaton.solve(mirror) == repair.Suffixes().solve(mirror)
    assert automaton.made == len({m[:i] for m in signatures for i in range(1, len(m) + 1)})


def test_no_conversations_and_empty_texts(spark):
    assert Repair(spark.createDataFrame([], SCHEMA)).summary().count() == 0
    long = "word " * 200_000 + "end."
    got = Repair(spark.createDataFrame([(1, 0, "user", long, 0, 1, None, None), (1, 1, "assistant", "", 0, 1, None, None)], SCHEMA)).summary().first()
    assert (got["blank"], got["cost"], got["audit"]) == (1, 4, "DD")
