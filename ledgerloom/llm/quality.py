"""Quality classifier: similarity-weighted voting of nearest labelled latent-semantic vectors."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import labelled_sample, text_slices, with_judgement

# Features of a text: shapes of its words, the words themselves, and how it repeats itself.
SHAPES, WORDS, REPEATS = 384, 512, 24
FEATURES = SHAPES + WORDS + REPEATS
# Distinct chunks whose features are kept, some 40 MB.
CHUNKS_KEPT = 250_000
# Rows of a block of cosine products.
BLOCK = 256
DIGITS = re.compile(r"\d+")
LOWER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def shape(chunk: str) -> str:
    """The chunk with runs of small letters, capitals and digits as one sign each, other runs cut to two signs."""
    text = DIGITS.sub("0", UPPER.sub("A", LOWER.sub("a", chunk)))
    return re.sub(r"(.)\1+", r"\1\1", text)


def bucket(text: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % size


class Chunks(dict):
    """Numbers chunks and keeps their two features."""

    def __init__(self):
        super().__init__()
        self.pairs = array("H")

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        letters = "".join(filter(str.isalpha, chunk)).lower()
        self.pairs.extend((bucket(shape(chunk), SHAPES), SHAPES + bucket(letters, WORDS)))
        return number


class Featurizer:
    def __init__(self):
        self.chunks = Chunks()

    def of(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: square roots of feature shares, so that a text's own length has no weight."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks = Chunks()
        get = self.chunks.__getitem__
        codes = [np.array(list(map(get, (t or "").split())), dtype=np.int64) for t in texts]
        pairs = np.frombuffer(self.chunks.pairs, dtype=np.uint16).reshape(-1, 2)
        out = np.zeros((len(texts), FEATURES), dtype=np.float32)
        for i, c in enumerate(codes):
            n = len(c)
            if not n:
                continue
            out[i] = np.bincount(pairs[c].ravel(), minlength=FEATURES)
            # Shares of words that repeat the word before, and of distinct words, on a coarse scale.
            same = np.count_nonzero(c[1:] == c[:-1])
            out[i] /= n
            out[i, FEATURES - REPEATS + min(11, int(16 * same / n))] = 1.0
            out[i, FEATURES - 12 + min(11, int(12 * len(np.unique(c)) / n))] = 0.25
        return np.sqrt(out)


class QualityModel:
    """Feature weights, the projection into latent space, and the labelled vectors in it."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int):
        self.neighbours = min(neighbours, len(labels))
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.weights = np.ones(FEATURES, dtype=np.float32)
        self.projection = np.zeros((FEATURES, 1), dtype=np.float32)
        self.vectors = np.zeros((len(labels), 1), dtype=np.float32)
        if not len(labels):
            return
        one, zero = features[labels == 1], features[labels == 0]
        if len(one) and len(zero):
            # A feature counts by how far apart the labels are in it, rare features by little.
            spread = np.sqrt((one.var(axis=0) + zero.var(axis=0)) / 2) + 0.02
            self.weights = (0.05 + np.abs(one.mean(axis=0) - zero.mean(axis=0)) / spread).astype(np.float32)
        weighted = features * self.weights
        _, _, right = np.linalg.svd(weighted, full_matrices=False)
        self.projection = np.ascontiguousarray(right[:dimensions].T.astype(np.float32))
        self.vectors = self.latent(features)

    def latent(self, features: np.ndarray) -> np.ndarray:
        out = (features * self.weights) @ self.projection
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

    def score(self, features: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its similarity."""
        out = np.full(len(features), self.prior)
        if not self.neighbours:
            return out
        for at in range(0, len(features), BLOCK):
            latent = self.latent(features[at : at + BLOCK])
            cosine = latent @ self.vectors.T
            near = np.argpartition(cosine, cosine.shape[1] - self.neighbours, axis=1)[:, -self.neighbours :]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            found = total > 1e-9
            out[at : at + BLOCK][found] = votes[found] / total[found]
        return out


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: F.Column,
    sample_rows: int = 3000,
    dimensions: int = 48,
    neighbours: int = 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Learn from at most ``sample_rows`` distinct labelled texts (a documented bound), chosen by a hash of the text.

    ``train`` is a condition on the label table's id. Labels other than 0 and 1, and null ids, are left out.
    """
    rows = labelled_sample(docs, labels, train, sample_rows, id_col, text_col, label_col).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for batch in batches:
            for part in text_slices(batch, 1):
                values = [v.tobytes() for v in featurizer.of(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.binary())], names=["label", "features"])

    got = sorted((r["features"], r["label"]) for r in rows.mapInArrow(run, "label int, features binary").collect())
    features = np.array([np.frombuffer(f, dtype=np.float32) for f, _ in got], dtype=np.float32).reshape(-1, FEATURES)
    return QualityModel(features, np.array([y for _, y in got], dtype=np.int64), dimensions, neighbours)


def score_quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from 0.5 on) of whole texts.

    A text's latent vector is compared with all labelled vectors, which every task has (at most the
    sample's bound), in blocks of exact cosine products; the nearest ones vote, weighted by similarity.

    A narrow pass. Null and empty texts, and texts that are like no labelled one, get the share of
    label 1 in the sample (0.5 without any). Columns in ``keep`` are carried along.
    """

    def make():
        featurizer = Featurizer()

        def judge(texts: list[str | None]) -> list[pa.Array]:
            score = model.score(featurizer.of(texts))
            return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return judge

    return with_judgement(docs, id_col, text_col, keep, {"score": "double", "predicted": "int"}, make)
