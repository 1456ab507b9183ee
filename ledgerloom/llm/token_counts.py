"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import per_worker, text_slices
from ledgerloom.llm.tokenizer import CACHE_ENTRIES, PerChunk, byte_signs, load, merges_here, plain_chunks, read_tokenizer, splits_here


PAIR_BITS = 20
NONE = (1 << PAIR_BITS) - 1


def merges_made(symbols: list[int], ranks: dict[int, int], results: list[int]) -> int:
    """How many merges byte-pair encoding makes in a word of the given symbols.

    The adjacent pair of the lowest rank, the leftmost among equals, is merged until no adjacent
    pair has a rank. ``ranks`` maps ``left << PAIR_BITS | right`` to the rank, ``results`` a rank to
    the merged symbol. Pairs wait in a heap as ``rank << 32 | position``; neighbours hang together in
    a linked list; an entry whose pair is no longer there is skipped.
    """
    n = len(symbols)
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        rank = rank_of(symbols[i] << PAIR_BITS | symbols[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return 0
    heapify(heap)
    # Position n is a stop on the right and, as index -1, on the left; no pair with it has a rank.
    after, before = [*range(1, n + 1), n], [-1, *range(n)]
    alive = [*symbols, NONE]
    made = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if rank_of(alive[i] << PAIR_BITS | alive[j]) != entry >> 32:
            continue
        made += 1
        alive[i] = merged = results[entry >> 32]
        alive[j] = NONE
        k = after[i] = after[j]
        before[k] = i
        rank = rank_of(merged << PAIR_BITS | alive[k])
        if rank is not None:
            heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(alive[h] << PAIR_BITS | merged)
            if rank is not None:
                heappush(heap, rank << 32 | h)
    return made


class TextCounts:
    """Counts tokens of whole texts under a byte-level BPE file, with word ends or without.

    The file's own normalizer and pre-tokenizer give the words, or rules here where they are known to be
    the same. A file whose words are not merged from bytes by rank alone is counted by the library.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        self.tokenizer = tokenizer = load(content)
        self.merges, self.fast = merges_here(spec), splits_here(spec)
        if not self.merges:
            return
        model = spec["model"]
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {vocabulary[a] << PAIR_BITS | vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.results = [vocabulary[a + b] for a, b in pairs]
        suffix = model["end_of_word_suffix"] or ""
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        # The sign that stands for each byte, first within a word and then at its end.
        signs = byte_signs()
        self.inner, self.last = ([vocabulary[s + end] for s in signs] for end in ("", suffix))
        self.signs = {s: i for i, s in enumerate(signs)}
        self.chunks = PerChunk(lambda word: self.count_word(word.encode()), sum, 2 * CACHE_ENTRIES)

    def count_word(self, word: bytes) -> int:
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        return len(symbols) - merges_made(symbols, self.ranks, self.results)

    def count_any(self, text: str) -> int:
        """Any text by the library's own normalizer and pre-tokenizer, special strings apart."""
        specials = self.specials.findall(text)
        parts = self.specials.split(text) if specials else [text]
        pieces = [p for part in parts if part for p, _ in self.split(self.normalize(part)) if p]
        return len(specials) + sum(self.count_word(bytes(self.signs[c] for c in p)) for p in pieces)

    def of(self, texts: list[str]) -> list[int]:
        if not self.merges:
            return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        chunks = map(plain_chunks, texts) if self.fast else [None] * len(texts)
        return [self.count_any(t) if c is None else self.chunks.of(c) for t, c in zip(texts, chunks, strict=True)]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``).

    A word starts as its byte symbols, the last of which carries the word end, and loses one per
    merge, so its count is symbols minus merges (:func:`merges_made`). Counts are kept per distinct
    word; special strings inside a text count as one token each, as the library's default has it.

    A single narrow pass without a shuffle. A null text counts as empty: 0 bytes, 0 tokens, not over
    the limit. Null ids, repeated rows and other columns change nothing.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker("counts", content.value, TextCounts)
        for batch in batches:
            for rows in text_slices(batch, 1):
                n = pa.array(counts.of([t or "" for t in rows.column(1).to_pylist()]), pa.int64())
                size = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), size, n, pc.greater(n, limit)], names=["doc", "n_bytes", "n_tokens", "over_limit"]
                )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
    return rows.withColumnRenamed("doc", id_col)
