"""Packing by power-of-two decomposition: every piece is a sequence of its own."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import per_worker, text_slices
from ledgerloom.llm.tokenizer import PerChunk, byte_signs, load, plain_chunks, read_tokenizer, splits_here


def pieces_of(total: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: as many of ``longest`` as fit, then the set bits of the rest."""
    whole, rest = divmod(total, longest)
    out = [(i * longest, longest) for i in range(whole)]
    at = whole * longest
    while rest:
        bit = 1 << (rest.bit_length() - 1)
        out.append((at, bit))
        at, rest = at + bit, rest - bit
    return out


class TextIds:
    """Token ids of whole texts as little-endian 32-bit bytes, exactly as the tokenizer library gives them.

    Where the file's rules for words are known, ids are kept per distinct chunk of text, as every word
    stands on its own; any other file is left to the library.
    """

    def __init__(self, content: str):
        self.tokenizer, self.fast = load(content), splits_here(json.loads(content))
        self.tokenize = self.tokenizer.model.tokenize
        self.signs = byte_signs()
        self.chunks = PerChunk(self.of_word, b"".join)

    def of_word(self, word: str) -> bytes:
        signs = word if word.isascii() and word.isprintable() else "".join(self.signs[b] for b in word.encode())
        ids = [t.id for t in self.tokenize(signs)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def of(self, texts: list[str]) -> list[bytes]:
        chunks = map(plain_chunks, texts) if self.fast else [None] * len(texts)
        return [self.whole(t) if c is None else self.chunks.of(c) for t, c in zip(texts, chunks, strict=True)]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    longest: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Token sequences of power-of-two lengths, none of which crosses documents.

    A document is its token ids followed by ``end_id``. It is cut into as many pieces of ``longest``
    (a power of two) as fit and one piece for each set bit of the rest, longest first; every piece is
    one sequence, so no sequence needs padding. ``bucket`` is the piece's length: sequences of one
    bucket make batches without padding (:func:`write_buckets`). With ``with_ids`` the rows carry
    the ids themselves.

    A single narrow pass: no shuffle, and memory bounded by a slice of texts. A null or empty text
    gives the one piece that holds ``end_id``; a null id, repeated rows and other columns change
    nothing, as every row is packed on its own. ``sequence_id`` is unique, not gapless.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker("ids", content.value, TextIds)
        for batch in batches:
            for rows in text_slices(batch, 1):
                texts = [t or "" for t in rows.column(1).to_pylist()]
                row, starts, lengths, sums, totals, ids = [], [], [], [], [], []
                for i, raw in enumerate(ids_of.of(texts)):
                    raw += end
                    total = len(raw) // 4
                    for start, length in pieces_of(total, longest):
                        piece = raw[4 * start : 4 * (start + length)]
                        row.append(i)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(piece))
                        totals.append(total)
                        if with_ids:
                            ids.append(piece)
                columns = [rows.column(0).take(pa.array(row, pa.int64()))]
                columns += [pa.array(v, pa.int64()) for v in (starts, lengths, sums, totals)]
                columns.append(pa.array(lengths, pa.int32()))
                names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:
                    offsets = np.cumsum([0, *lengths]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else "")
    )
    return rows.select(
        F.col("doc").alias(id_col),
        *(c for c in rows.columns if c not in ("doc", "ids")),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences with one folder per length, for batches that need no padding."""
    packed.write.partitionBy("bucket").parquet(path)
