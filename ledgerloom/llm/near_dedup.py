"""Near-duplicate documents: MinHash signatures, banding, checks on full sets, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import text_slices, written
from ledgerloom.llm.components import connected_components
from ledgerloom.operators.grouped import sorted_groups

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
# Members of a bucket, and shingles of their sets, that one block holds; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
# Sets are hashed in runs of this many shingles.
RUN = 1 << 15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def universal_hashes(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the multiply-add-shift family, which is strongly universal on 32-bit keys."""
    random = np.random.default_rng(seed)
    full = np.iinfo(np.uint64).max
    return (
        random.integers(0, full, HASHES, dtype=np.uint64, endpoint=True),
        random.integers(0, full, HASHES, dtype=np.uint64, endpoint=True),
    )


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """Shingle sets of texts: hashes of runs of ``size`` words; a shorter text with words is one run."""

    def __init__(self, size: int):
        self.size, self.known = size, WordHashes()

    def of(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """The sorted set of 64-bit shingle hashes, and a digest of the text's words."""
        words = text.encode().translate(LOWER).split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64), b""
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.size, len(words))
        n = len(words) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out), xxhash.xxh3_128_digest(b" ".join(words))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all universal hashes for each (non-empty) set, as (sets, hashes) of 32 bits."""
    factor, offset = universal_hashes()
    out = np.full((len(sets), HASHES), np.iinfo(np.uint32).max, dtype=np.uint32)
    starts = np.cumsum([0, *map(len, sets)])
    at = 0
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + RUN, side="right")) - 1)
        keys = np.concatenate(sets[at:stop]) & np.uint64(0xFFFFFFFF)
        begin = starts[at:stop] - starts[at]
        for h in range(HASHES):
            value = ((keys * factor[h] + offset[h]) >> np.uint64(32)).astype(np.uint32)
            out[at:stop, h] = np.minimum.reduceat(value, begin)
        at = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: equal exactly if the band's minima are (up to hash collisions)."""
    n = len(signature)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    parts = signature.reshape(n, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: doc, n_shingles, words (digest, null without words), bands, low (a byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            for rows in text_slices(batch, 1):
                found = [shingles.of(t) for t in rows.column(1).to_pylist()]
                full = [i for i, (s, _) in enumerate(found) if len(s)]
                minima = signatures([found[i][0] for i in full])
                keys, low = band_keys(minima), (minima & np.uint32(255)).astype(np.uint8)
                bands: list = [None] * len(found)
                lows: list = [None] * len(found)
                for j, i in enumerate(full):
                    bands[i], lows[i] = keys[j], low[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(s) for s, _ in found], pa.int64()),
                        pa.array([d or None for _, d in found], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(lows, pa.binary()),
                    ],
                    names=["doc", "n_shingles", "words", "bands", "low"],
                )

    return docs.mapInArrow(run, "doc bigint, n_shingles bigint, words binary, bands array<bigint>, low binary")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            for rows in text_slices(batch, 1):
                sets = [shingles.of(t)[0].view(np.int64) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "shingles"]
                )

    return docs.mapInArrow(run, "doc bigint, shingles array<bigint>")


def agreement(low: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity from the bytes of two signatures, freed from chance agreement of bytes."""
    share = (low == other).mean(axis=-1)
    return (share - 1 / 256) / (1 - 1 / 256)


def likely(pairs: DataFrame, cut: float) -> DataFrame:
    """Signature verification: pairs (a, b, low_a, low_b) whose estimate reaches ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = [
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
                    for i in (2, 3)
                ]
                yield batch.select(["a", "b"]).filter(pa.array(agreement(*low) >= cut))

    return pairs.select("a", "b", "low_a", "low_b").mapInArrow(run, "a bigint, b bigint")


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)


def linking(cut: float, percent: int):
    """Function for :func:`sorted_groups`: links between members of a cell that are not connected yet.

    A cell holds one block, whose members all meet, or two (``side`` 0 and 1), whose members meet across only,
    as each block meets itself in a cell of its own.
    """

    def links_of(ids: list, roots: list, sets: list[np.ndarray], low: np.ndarray, side: np.ndarray, across: bool) -> Iterator[tuple[int, int]]:
        forest = Forest(roots)
        sizes = np.array([len(s) for s in sets])
        for i in np.flatnonzero(side == 0).tolist():
            others = np.flatnonzero(side) if across else np.arange(i + 1, len(ids))
            near = np.minimum(sizes[i], sizes[others]) * 100 >= percent * np.maximum(sizes[i], sizes[others])
            others = others[near]
            for j in others[agreement(low[i], low[others]) >= cut].tolist() if len(others) else []:
                if forest.root(i) == forest.root(j):
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                    forest.join(i, j)
                    yield ids[i], ids[j]

    def fn(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        a, b = [], []
        for start, stop in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            part = rows.slice(start, stop - start)
            ids, roots = part.column("doc").to_pylist(), part.column("root").to_pylist()
            if len(set(roots)) < 2:
                continue
            sets = [np.asarray(s.values, dtype=np.int64).view(np.uint64) for s in part.column("shingles")]
            low = np.frombuffer(b"".join(part.column("low").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
            c, d, i, j = (part.column(n)[0].as_py() for n in "cdij")
            for x, y in links_of(ids, roots, sets, low, part.column("side").to_numpy(), (c, i) != (d, j)):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return fn


def cells(open_buckets: DataFrame, percent: int) -> DataFrame:
    """(band, c, d, i, j, side, doc, root): the cells in which members of a bucket (band, doc, root, n_shingles) meet.

    A bucket that fits into a block is one cell. In a longer one, as linked sets differ in size by the factor
    ``100 / percent`` at most, sizes fall into classes of that width, and a member meets its own class and the next ones on both sides only. A class with many rows is cut into blocks; block i of
    class c meets block j of class d in one cell, and no pair meets twice.
    """
    width = max(math.log(100 / percent), 1e-3) * (1 + 1e-6)
    long = (F.count("*") > BLOCK) | (F.sum("n_shingles") > BLOCK_SHINGLES)
    lengths = open_buckets.groupBy("band").agg(long.alias("long"))
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / width).cast("int")
    classed = open_buckets.join(lengths, "band").withColumn("c", F.when(F.col("long"), size_class).otherwise(0)).drop("long")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    by_class = Window.partitionBy("band").orderBy("c")
    beside = lambda step, by: F.when(step("c").over(by_class) == F.col("c") + by, step("blocks").over(by_class))
    sizes = classed.groupBy("band", "c").agg(blocks.alias("blocks")).withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)})
    mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    zero, c = F.lit(0), F.col("c")

    def cell(low: Column, high: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(low.alias("c"), high.alias("d"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def each(n: str, body) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(zero, F.col(n) - 1), body)).otherwise(F.array().cast(kind))

    kind = "array<struct<c:int,d:int,i:int,j:int,side:int>>"
    own = each("blocks", lambda k: cell(c, c, F.least(k, mine), F.greatest(k, mine), F.when(k < mine, 1).otherwise(0)))
    above = each("above", lambda k: cell(c, c + 1, mine, k, zero))
    below = each("below", lambda k: cell(c - 1, c, k, mine, F.lit(1)))
    placed = classed.join(sizes.fillna(0, ["below", "above"]), ["band", "c"])
    return placed.select("band", "doc", "root", F.inline(F.concat(own, above, below)))


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of near-duplicate documents: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Words are what white space separates, with A-Z in lower case; a document's set holds its distinct
    runs of ``shingle`` words (fewer words are one run). Documents are linked if
    ``100 * intersection >= percent * union`` of the full sets; ``component_id`` is the smallest id
    that links reach, ``kept`` marks the document that has it.

    1. Each text gets 240 minima of strongly universal hashes, cut into 40 bands of 6. At 85 % two
       texts share no band with a chance below 1e-8, at 80 % below 6e-6.
    2. Texts with the same words are one node, named by their smallest id.
    3. In every band's buckets all members are paired with the smallest one only; pairs whose
       signatures can agree are confirmed on full sets, and components are built from them.
    4. Buckets whose other members still lie in several components compare these in blocks of like size: only pairs
       across components, signatures first, then full sets, and only links that connect are returned. So
       a group of copies costs links in proportion to its size, and no link between components is lost.
    5. Components of all links.

    Ids must be whole numbers. Rows that share an id are one document. A null id is linked with
    nothing and kept. Without words or text the set is empty: linked with nothing and kept.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    cut = percent / 100 - 0.15
    sketch = written(sketches(source, shingle), "sketches")
    reps = written(
        sketch.where("words IS NOT NULL").groupBy("words").agg(F.min("doc").alias("rep")).where("rep IS NOT NULL"), "reps"
    )
    nodes = sketch.join(reps, [sketch["words"] == reps["words"], sketch["doc"] == reps["rep"]], "left_semi")
    banded = nodes.select("doc", "n_shingles", F.explode("bands").alias("band"))
    shared = written(
        banded.groupBy("band")
        .agg(F.min("doc").alias("least"), F.count("*").alias("n"))
        .where("n > 1"),
        "buckets",
    )
    members = banded.join(shared, "band").select("band", "doc", "least", "n_shingles")
    members = written(members.distinct(), "members")
    low = written(nodes.select("doc", "low"), "signatures")
    pairs = members.where("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
    pairs = pairs.join(low.select(F.col("doc").alias("a"), F.col("low").alias("low_a")), "a")
    pairs = pairs.join(low.select(F.col("doc").alias("b"), F.col("low").alias("low_b")), "b")
    checked = written(likely(pairs, cut), "pairs")

    needed = members.select("doc").distinct()
    sets = written(shingle_sets(source.join(needed, "doc", "left_semi"), shingle).distinct(), "sets")
    sizes = F.size("set_a") + F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    first = (
        checked.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b")
        .where(100 * both >= percent * (sizes - both))
        .select("a", "b")
    )
    stars = written(connected_components(first), "first-components")

    # Pairs with the smallest member are settled, so what is left of a bucket are its other members.
    others = members.where("doc <> least")
    placed = others.join(stars.withColumnRenamed("node", "doc"), "doc", "left").select(
        "band", "doc", "n_shingles", F.coalesce("component", "doc").alias("root")
    )
    open_bands = written(
        placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band"),
        "open-buckets",
    )
    met = cells(placed.join(open_bands, "band"), percent).join(low, "doc").join(sets, "doc")
    columns = ["band", "c", "d", "i", "j"]
    second = sorted_groups(
        met.select(*columns, "doc", "root", "side", "low", "shingles"), columns, ["doc"], linking(cut, percent), LINK
    )
    links = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)
    final = written(connected_components(links), "components")

    named = sketch.select("doc", "n_shingles", "words").join(reps, "words", "left")
    return (
        named.join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "rep", "doc").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
