"""Benchmark decontamination by a prefix-filtered join of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices, written
from ledgerloom.llm.licenses import SEPARATORS

# Words of a shingle. A window of fewer words is one shingle.
SHINGLE = 3
# The filter that tasks get is a table of 16 bits or more per token, of 2 MB at least and 32 MB at most; a fuller table lets
# more places pass, which costs time and changes nothing.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 28
PLACES = pa.list_(
    pa.struct([("token", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())])
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(SEPARATORS).split() if text else []


class WordHashes(dict):
    """Hashes of words, computed once per distinct word; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Hash of the ``size`` words from every position on at which so many are left."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64)
    return mixed(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)), size)


def mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Combine word hashes into hashes of runs of ``size`` words."""
    n = len(hashes) - size + 1
    out = np.full(max(n, 0), size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def content_of(text_col: str) -> F.Column:
    """Together with the id this tells the rows of a table apart as far as results may differ."""
    return F.xxhash64(F.col(text_col).cast("string"))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """One row per distinct item and window: item, window (its words), tokens (shingle hashes), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for rows in text_slices(batch, 1):
                item, texts, tokens = [], [], []
                for i, text in enumerate(rows.column(1).to_pylist()):
                    words = words_of(text)
                    size = min(window, len(words))
                    part = min(SHINGLE, size)
                    for at in range(len(words) - size + 1 if words else 0):
                        item.append(i)
                        texts.append(b" ".join(words[at : at + size]).decode())
                        tokens.append(as_long(shingle_hashes(words[at : at + size], part, known)))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(item, pa.int64())),
                        pa.array(texts, pa.string()),
                        pa.array(tokens, pa.list_(pa.int64())),
                    ],
                    names=["item", "window", "tokens"],
                )

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.where("item IS NOT NULL").mapInArrow(run, "item string, window string, tokens array<bigint>").distinct()


def filter_bits(tokens: int) -> int:
    """Size of the filter for so many distinct tokens, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * tokens).bit_length()))


def token_filter(tokens: DataFrame, bits: int) -> bytes:
    """A bit table in which every token of the frame is set.

    Tasks join the bits of each 64-bit word, so the driver gets at most ``bits / 64`` numbers.
    """
    word = F.expr(f"shiftright(token & {bits - 1}L, 6)").alias("word")
    joined = F.expr("bit_or(shiftleft(1L, CAST(token & 63L AS INT)))").alias("bits")
    found = tokens.groupBy(word).agg(joined).toArrow()
    table = np.zeros(bits // 64, dtype="<i8")
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def passing(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places whose hash is in the filter."""
    at = hashes & np.uint64(8 * len(table) - 1)
    return np.flatnonzero(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def judged(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All documents (doc, content, n_words), and those that hold a window (hit_doc, hit_content, n_hit, items).

    ``content`` is a hash of the text (:func:`content_of`). See :func:`decontaminate` for the method.
    """
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, item_col, item_text_col, window), "windows")
    distinct = windows.select("window", "tokens").distinct()
    every = windows.select(F.explode("tokens").alias("token"), F.size("tokens").alias("size"), "window")
    sizes = sorted(r[0] for r in every.select(F.size(F.split("window", " ")).alias("n")).distinct().collect())
    parts = sorted({min(SHINGLE, n) for n in sizes})
    texts = docs.select(
        F.col(id_col).alias("doc"), content_of(text_col).alias("content"), F.col(text_col).cast("string").alias("text")
    )
    bits = filter_bits(every.select("token").distinct().count())
    every_filter = spark.sparkContext.broadcast(token_filter(every, bits))

    def hashed(words: list[bytes], table: np.ndarray, known: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per shingle size the hashes of all places, and the places whose hash is in the filter."""
        for size in parts:
            hashes = shingle_hashes(words, size, known)
            yield hashes, passing(hashes, table)

    def tokens_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every document's word count and distinct tokens that pass the filter of all windows, and its text if it has any."""
        table, known = np.frombuffer(every_filter.value, dtype=np.uint8), WordHashes()
        for batch in batches:
            for rows in text_slices(batch, 2):
                counts, held = [], []
                given = rows.column(2).to_pylist()
                for text in given:
                    words = words_of(text)
                    counts.append(len(words))
                    mine = [as_long(np.unique(h[hits])) for h, hits in hashed(words, table, known) if len(hits)]
                    held.append(np.unique(np.concatenate(mine)) if mine else None)
                kept = [None if h is None else t for t, h in zip(given, held, strict=True)]
                columns = [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(held, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(kept, pa.string())],
                    names=["doc", "content", "n_words", "tokens", "text"],
                )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's places of prefix tokens with the words around."""
        table, known = np.frombuffer(prefix_filter.value, dtype=np.uint8), WordHashes()
        for batch in batches:
            for rows in text_slices(batch, 3):
                found = []
                for text in rows.column(3).to_pylist():
                    words, mine = words_of(text), []
                    for hashes, hits in hashed(words, table, known):
                        for p, token in zip(hits.tolist(), as_long(hashes[hits]).tolist(), strict=True):
                            low = max(0, p - window)
                            context = b" ".join(words[low : p + window]).decode()
                            mine.append({"token": token, "at": p, "before": p - low, "context": context})
                    found.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array(found, PLACES)], names=["doc", "content", "total", "places"]
                )

    # One pass over all texts; what follows reads the texts of documents with a token of some window only.
    held = written(
        texts.mapInArrow(tokens_held, f"doc {kind}, content bigint, n_words bigint, tokens array<bigint>, text string"), "held"
    )
    # Document frequencies of all shingles of windows, then the rarest shingle of every window.
    frequency = held.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = (
        distinct.select("window", F.posexplode("tokens").alias("inside", "token"))
        .join(frequency, "token", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "inside")).alias("rarest"))
    )
    prefixes = written(
        ranked.select("window", "rarest.token", "rarest.inside", F.size(F.split("window", " ")).alias("words")).where(
            "rarest.n > 0"
        ),
        "prefixes",
    )
    prefix_filter = spark.sparkContext.broadcast(token_filter(prefixes, bits))
    place = "struct<token: bigint, at: int, before: int, context: string>"
    holding = held.where("text IS NOT NULL").select("doc", "content", "n_words", "text")
    placed = holding.mapInArrow(places, f"doc {kind}, content bigint, total bigint, places array<{place}>")
    found = placed.select("doc", "content", "total", F.explode("places").alias("place"))
    found = found.select("doc", "content", "total", "place.*")
    start = F.col("before") - F.col("inside")
    fits = (start >= 0) & (F.col("at") - F.col("inside") + F.col("words") <= F.col("total"))
    same = F.concat_ws(" ", F.slice(F.split("context", " "), F.greatest(start, F.lit(0)) + 1, F.col("words")))
    hits = written(
        found.join(prefixes, "token")
        .where(fits & (same == F.col("window")))
        .select("doc", "content", (F.col("at") - F.col("inside")).alias("first"), "words", "window")
        .distinct(),
        "hits",
    )
    spans = hits.groupBy("doc", "content").agg(F.collect_set(F.struct("first", "words")).alias("spans"))
    items = (
        hits.select("doc", "content", "window")
        .distinct()
        .join(windows.select("item", "window"), "window")
        .groupBy("doc", "content")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hit = spans.join(items, [spans["doc"].eqNullSafe(items["doc"]), spans["content"] == items["content"]]).select(
        spans["doc"].alias("hit_doc"), spans["content"].alias("hit_content"), "spans", "items"
    )
    hit = hit.select("hit_doc", "hit_content", covered("spans").alias("n_hit"), "items")
    return held.select("doc", "content", "n_words"), written(hit, "contaminated")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a window of a benchmark item, one row per input row.

    Words are lower-case runs of ASCII letters, digits and non-ASCII characters. A window is
    ``window`` consecutive words of an item (a shorter item with words is one window); it occurs where
    its words stand in a document one after another. Returns the id, ``n_words``, ``n_hit`` (words
    inside any occurrence), ``n_items``, ``items`` (ids of items with occurring windows, sorted as
    strings), ``items_sha256`` (of the ids joined by commas) and ``contaminated``.

    The join is prefix-filtered. A window's set is its shingles of three words. All shingles that
    occur in windows are ordered by how many documents hold them, and as containment must be
    complete, the rarest one of a window is a sufficient prefix: a document that lacks it cannot
    hold the window. Documents send the places of such tokens only (a bit table of bounded size lets
    the others go before the shuffle) with the words around; a joined place fixes where the window
    must start (position bound), it must fit into the document (length bound), and its words must be
    exactly the window's.

    A null text has no words. Rows without an id are judged too; rows that share id and text share
    their result. Items without id or words have no windows. An empty benchmark hits nothing.
    """
    counted, hit = judged(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    joined = counted.join(
        hit, counted["doc"].eqNullSafe(hit["hit_doc"]) & (counted["content"] == hit["hit_content"]), "left"
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def covered(column: str) -> F.Column:
    """Number of words that the spans (first, words) cover together."""
    ordered = F.array_sort(column)
    empty = F.struct(F.lit(-1).cast("int").alias("reach"), F.lit(0).cast("int").alias("n"))

    def step(state, span):
        last = span["first"] + span["words"] - 1
        new = F.greatest(last - F.greatest(state["reach"], span["first"] - 1), F.lit(0))
        return F.struct(F.greatest(state["reach"], last).alias("reach"), (state["n"] + new).cast("int").alias("n"))

    return F.aggregate(ordered, empty, step, lambda s: s["n"])
