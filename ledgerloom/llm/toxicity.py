"""Toxicity: what a text's windows cost to compress with a dictionary of toxic text and with one of ordinary text."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import labelled_sample, with_judgement

# Windows of eight words begin at every second word; a word without spaces is cut into pieces of this many bytes.
WINDOW, STRIDE = 8, 2
WORD = re.compile(rb"\S{1,32}")
# Long texts are taken in parts of so many bytes.
PART_BYTES = 1 << 20
ORDINARY_BYTES, TOXIC_BYTES = 32768, 2048
# Bytes that the toxic dictionary saves in a window, from none to this many or more.
LEVELS = 5
# A trained dictionary ends its tables with the offsets 1, 4 and 8, and its content follows (fixed by the format).
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
LEVEL = 5


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def windows(data: bytes) -> Iterator[memoryview]:
    """Overlapping windows over all words, each with a space before and after every word."""
    for at in range(0, len(data), PART_BYTES):
        words = WORD.findall(data, at, min(at + PART_BYTES, len(data)))
        if not words:
            continue
        joined = memoryview(b" " + b" ".join(words) + b" ")
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
        for first in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
            yield joined[starts[first] : starts[min(first + WINDOW, len(words))] + 1]


def trained(samples: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Tables and content of a dictionary; of samples too few to train on, the samples themselves."""
    try:
        raw = zstandard.train_dictionary(size, samples).as_bytes()
        at = raw.index(OFFSETS) + len(OFFSETS)
        return raw[:at], raw[at:]
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(dict.fromkeys(samples))[-size:]


def compressor(raw: bytes):
    # Without the frame's optional parts, so that lengths are those of the window alone.
    bare = {"write_content_size": False, "write_dict_id": False, "write_checksum": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **bare)
    known = zstandard.ZstdCompressionDict(raw)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress


def beginnings(word: str) -> tuple[str, ...]:
    return (word[:4], word[:5], word) if len(word) >= 4 else ()


def contexts(texts: Iterable[str]) -> tuple[dict[str, int], dict[str, int]]:
    """How many texts hold a beginning of a word, and behind which of 64 kinds of words it stands (a bit each)."""
    count: dict[str, int] = {}
    behind: dict[str, int] = {}
    for text in texts:
        before, held = "", set()
        for word in text.lower().split():
            bit = 1 << (sum(before[-2:].encode("utf-8", "surrogatepass")) & 63)
            for start in beginnings(word):
                held.add(start)
                behind[start] = behind.get(start, 0) | bit
            before = word
        for start in held:
            count[start] = count.get(start, 0) + 1
    return count, behind


def telling(toxic: list[str], ordinary: list[str], times: float) -> set[str]:
    """Beginnings of words at least ``times`` as frequent in toxic texts, in contexts too many to come from copies."""
    count, behind = contexts(toxic)
    other, _ = contexts(ordinary)
    texts, need = max(3, len(toxic) // 100), max(3, min(16, len(toxic) // 10))
    ratio = times * len(toxic) / len(ordinary)
    return {
        s for s, n in count.items() if n >= texts and behind[s].bit_count() >= need and n >= ratio * (other.get(s, 0) + 0.2)
    }


class ToxicityModel:
    """Two dictionaries, what each level of saving says about a window, and the threshold for a text.

    Toxic documents are mostly ordinary text, so their dictionary is the ordinary one, tables included, behind
    what was trained on the words that set them apart. Lengths then differ by little else than those words.
    """

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.prior = len(toxic) / (len(toxic) + len(ordinary)) if toxic or ordinary else 0.0
        self.weights, self.threshold = None, 0.0
        if not toxic or not ordinary:
            return
        # With enough labelled text, thresholds are calibrated on the half that no dictionary has seen.
        held = min(len(toxic), len(ordinary)) >= 100
        learn, calibrate = (slice(0, None, 2), slice(1, None, 2)) if held else (slice(None), slice(None))
        known = telling(toxic[learn], ordinary[learn], 12.0)
        words = [
            f" {w} ".encode("utf-8", "surrogatepass")
            for t in toxic[learn]
            for w in t.lower().split()
            if not known.isdisjoint(beginnings(w)) and len(w) <= 64
        ]
        if not words:
            return
        plain = [bytes(w) for t in ordinary[learn] for w in itertools.islice(windows(normal(t)), 0, 400, WINDOW // STRIDE)]
        tables, content = trained(plain, ORDINARY_BYTES)
        self.dictionaries = tables + content, tables + trained(words, TOXIC_BYTES)[1] + content
        bad, good = (np.array([self.levels(t) for t in some[calibrate]]) for some in (toxic, ordinary))
        shares = [some.sum(axis=0) / max(some.sum(), 1) for some in (bad, good)]
        weights = np.log((shares[0] + 1e-5) / (shares[1] + 1e-5))
        weights[0] = min(weights[0], 0)
        self.weights = np.maximum.accumulate(weights)
        self.threshold = self._calibrated(bad @ self.weights, good @ self.weights)

    @staticmethod
    def _calibrated(bad: np.ndarray, good: np.ndarray) -> float:
        """The threshold with the best share of toxic texts found less twice that of ordinary ones; in the middle of its gap."""
        every = np.unique(np.concatenate([bad, good]))
        cuts = np.concatenate([every[:1] - 1, (every[1:] + every[:-1]) / 2, every[-1:] + 1])
        value = 2 * np.searchsorted(np.sort(good), cuts) / len(good) - np.searchsorted(np.sort(bad), cuts) / len(bad)
        best = np.flatnonzero(value == value.max())
        widths = np.diff(np.concatenate([cuts[:1] - 1, every, cuts[-1:] + 1]))
        return float(cuts[best[np.argmax(widths[best])]])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lengths"}

    def levels(self, text: str | None) -> np.ndarray:
        """Windows of the text by how many bytes the toxic dictionary saves."""
        if "lengths" not in self.__dict__:
            self.lengths = tuple(map(compressor, self.dictionaries))
        ordinary, toxic = self.lengths
        found = [0] * LEVELS
        for window in windows(normal(text)):
            found[max(0, min(len(ordinary(window)) - len(toxic(window)), LEVELS - 1))] += 1
        return np.array(found)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return min(self.prior, 0.49)
        over = float(self.levels(text) @ self.weights) - self.threshold
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, over))))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    toxic_rows: int = 1000,
    ordinary_rows: int = 1500,
    sample_chars: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Learn from at most ``toxic_rows`` and ``ordinary_rows`` distinct labelled texts, chosen by a hash of the text.

    These, and that at most ``sample_chars`` characters of a labelled text are learned from, are documented
    bounds of the fit; scoring reads whole texts. ``train`` is a condition on the label table's id. Labels
    other than 0 and 1, and null ids, are left out.
    """
    rows = labelled_sample(docs, labels, train, {1: toxic_rows, 0: ordinary_rows}, id_col, text_col, label_col)
    got = rows.select("label", F.substring("text", 1, sample_chars).alias("text"), "mark").collect()
    got.sort(key=lambda r: (r["mark"], r["text"]))
    return ToxicityModel(*([r["text"] for r in got if r["label"] == label] for label in (1, 0)))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from 0.5 on) of whole texts.

    Every window of eight words is compressed with both dictionaries; the bytes that the toxic one saves
    count by the calibrated weight of their level, and the sum is held against the calibrated threshold.
    Windows do not cross the borders of parts of a megabyte. A narrow pass. Null and empty texts have no
    window. Without labelled texts of both kinds, or words that set them apart, all texts get the share
    of label 1 in the sample, or 0.49 if that is less. Columns in ``keep`` are carried along.
    """

    def make():
        def judge(texts: list[str | None]) -> list[pa.Array]:
            score = np.array([model.score(t) for t in texts], dtype=np.float64)
            return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return judge

    return with_judgement(docs, id_col, text_col, keep, {"score": "double", "predicted": "int"}, make)
