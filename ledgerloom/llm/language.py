"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import least_hashes, text_slices, with_judgement

# First code points of scripts and their names, in order (fixed values, from the Unicode charts).
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"),
)
STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])

# Letter runs of two and three signs, word edges included, fall into this many features.
FEATURES = 1 << 15
EDGE = 1
# Padded cells that one pass of the labelling holds.
CELLS = 2_000_000
# Distinct words whose scores are kept, some 20 MB.
WORDS_KEPT = 100_000
NO_WAY = np.float32(-50.0)


class Words(dict):
    """Numbers words in the order in which they are first met; ``fresh`` are those not scored yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of words: (feature, word) of every run of two or three signs, letters and script per word."""
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(words)), lengths + 2)
    codes = flat.astype(np.uint64)
    features, owners = [], []
    for size in (2, 3):
        n = len(codes) - size + 1
        if n <= 0:
            continue
        whole = of[:n] == of[size - 1 :]
        mixed = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            mixed = (mixed ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        features.append((mixed[whole] % np.uint64(FEATURES)).astype(np.int64))
        owners.append(of[:n][whole])
    letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), dtype=np.int64, count=len(words))
    first = np.fromiter((next((ord(c) for c in w if c.isalpha()), 0) for w in words), dtype=np.int64, count=len(words))
    script = SCRIPT_OF[np.searchsorted(STARTS, first, side="right") - 1]
    return np.concatenate(features), np.concatenate(owners), letters, script


class LanguageModel:
    """Log-probabilities of features per language, and the languages that use each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= 0.005).T.copy()

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word its score under every language (0 where its script says nothing), its letters, and
        those of them in a script that some language uses."""
        feature, owner, letters, script = grams(words)
        scores = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for i in range(len(self.languages)):
            scores[:, i] = np.bincount(owner, weights=self.log[feature, i], minlength=len(words))
        scores -= scores.max(axis=1, keepdims=True)
        uses = self.uses[script]
        scores[~uses & uses.any(axis=1, keepdims=True)] = NO_WAY
        scores[(letters == 0) | ~uses.any(axis=1)] = 0
        return np.maximum(scores, NO_WAY), letters, self.readable(words, letters)

    def readable(self, words: list[str], letters: np.ndarray) -> np.ndarray:
        """Per word its letters in a script that some language uses."""
        foreign = ~self.uses.any(axis=1)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        of = np.repeat(np.arange(len(words)), np.array([len(w) for w in words]))
        at = np.flatnonzero(foreign[SCRIPT_OF[np.searchsorted(STARTS, flat, side="right") - 1]])
        alpha = np.fromiter((chr(c).isalpha() for c in flat[at].tolist()), dtype=np.int64, count=len(at))
        return letters - np.bincount(of[at], weights=alpha, minlength=len(words)).astype(np.int64)


def best_paths(emit: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of many texts at once: ``emit`` is (words, languages, texts), padded behind ``lengths``.

    ``lengths`` must ascend. A path gains the score of each word's label and loses ``penalty`` where
    the label changes. Equal paths prefer not to change, then the first language. Returns (words, texts).
    """
    steps, labels, n = emit.shape
    value = emit[0].copy()
    switched = np.zeros((steps, labels, n), dtype=bool)
    source = np.zeros((steps, n), dtype=np.int16)
    begins = np.searchsorted(lengths, np.arange(steps), side="right")  # the first text that is longer
    for t in range(1, steps):
        live = value[:, begins[t] :]
        top, best = live[0].copy(), source[t, begins[t] :]
        for i in range(1, labels):
            better = live[i] > top
            np.copyto(top, live[i], where=better)
            np.copyto(best, i, where=better)
        top -= penalty
        np.greater(top, live, out=switched[t, :, begins[t] :])
        np.maximum(live, top, out=live)
        live += emit[t, :, begins[t] :]
    out = np.zeros((steps, n), dtype=np.int16)
    label = value.argmax(axis=0).astype(np.int16)
    columns = np.arange(n)
    for t in range(steps - 1, -1, -1):
        out[t] = label
        moved = switched[t, label, columns]
        if moved.any():
            label = np.where(moved, source[t], label)
    return out


def label_words(codes: list[np.ndarray], table: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Labels of the words of every text; texts of similar length are labelled together."""
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    out: list[np.ndarray] = [np.empty(0, dtype=np.int16)] * len(codes)
    at = 0
    while at < len(order):
        shortest, stop = lengths[order[at]], at + 1
        while stop < len(order):
            longest = lengths[order[stop]]
            if longest > 1.5 * shortest + 32 or longest * (stop - at + 1) * table.shape[1] > CELLS:
                break
            stop += 1
        group = order[at:stop]
        padded = np.zeros((len(group), lengths[group[-1]]), dtype=np.int32)
        for i, g in enumerate(group):
            padded[i, : lengths[g]] = codes[g]
        emit = np.ascontiguousarray(table[padded.T].transpose(0, 2, 1))
        paths = np.ascontiguousarray(best_paths(emit, lengths[group], penalty).T)
        for i, g in enumerate(group):
            out[g] = paths[i, : lengths[g]]
        at = stop
    return out


def fit_languages(
    docs: DataFrame,
    train: F.Column,
    sample_docs: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    most_languages: int = 256,
) -> LanguageModel:
    """Learn a model from the rows for which ``train`` holds and the language is known.

    Of each language at most ``sample_docs`` distinct texts are used, those with the least hash, and the
    ``most_languages`` most frequent languages (the documented bounds of the sample); whole texts count.
    Tasks count features of fixed number, which Spark sums.
    """
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in frequent.collect())
    counts = np.zeros((len(languages), FEATURES))
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    if not languages:
        return LanguageModel(languages, counts, scripts)
    marked = known.withColumn("mark", F.xxhash64("text"))
    chosen = least_hashes(marked.select("lang", "mark").distinct(), "lang", dict.fromkeys(languages, sample_docs))
    # At most ``sample_docs`` rows per language are broadcast.
    sample = marked.join(F.broadcast(chosen), ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))
    sample = sample.select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in text_slices(batch, 1):
                by_lang: dict[str, dict[str, int]] = {}
                for lang, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    seen = by_lang.setdefault(lang, {})
                    for w in text.lower().split():
                        seen[w] = seen.get(w, 0) + 1
                for lang, seen in by_lang.items():
                    if not seen:
                        continue
                    times = np.array(list(seen.values()))
                    feature, owner, letters, script = grams(list(seen))
                    total = sums.setdefault(lang, np.zeros(FEATURES + len(SCRIPTS)))
                    worded = letters[owner] > 0
                    total += np.bincount(feature[worded], weights=times[owner[worded]], minlength=len(total))
                    total += np.bincount(FEATURES + script, weights=times * letters, minlength=len(total))
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used), pa.array(total[used].astype(np.int64))],
                names=["lang", "feature", "n"],
            )

    summed = sample.mapInArrow(run, "lang string, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n"))
    for lang, feature, n in summed.collect():
        i = languages.index(lang)
        if feature < FEATURES:
            counts[i, feature] = n
        else:
            scripts[i, feature - FEATURES] = n
    return LanguageModel(languages, counts, scripts)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    penalty: float = 8.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    with_spans: bool = True,
) -> DataFrame:
    """Language of whole texts: the id, ``lang_pred``, ``score`` and, if wanted, ``spans``.

    The script of a word's first letter narrows its candidates to the languages that use the script;
    each candidate scores the word by its letter runs; Viterbi over the words of a text, with
    ``penalty`` for a change of language, labels spans (lang, first word, words). ``lang_pred`` is the
    label that covers most letters, ``score`` its share of the letters. Letters of a script that no
    language of the model uses count for no label, so they lower the score; a text of nothing else gets
    the first language by name, with score 0.

    A narrow pass; the model that tasks get has a fixed number of features per language. A text that
    is null or has no letter, or a model without languages, gives ``und`` with score 0; ties go to
    the first language by name. Columns in ``keep`` are carried along; others are ignored.
    """
    names = model.languages

    def make():
        words, table, letters, usable = Words(), np.zeros((0, len(names)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def judge(texts: list[str | None]) -> list[pa.Array]:
            nonlocal words, table, letters, usable
            if len(words) > WORDS_KEPT:
                words, table, letters, usable = Words(), table[:0], letters[:0], usable[:0]
            codes: list[np.ndarray] = []
            for text in texts:
                found = text.lower().split() if text and names else []
                codes.append(np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found)))
            if words.fresh:
                more, sizes, in_use = model.score(words.fresh)
                table, letters = np.concatenate([table, more]), np.concatenate([letters, sizes])
                usable = np.concatenate([usable, in_use])
                words.fresh = []
            pred, score, spans = [], [], []
            for c, path in zip(codes, label_words(codes, table, penalty), strict=True):
                total = int(letters[c].sum())
                if not total:
                    pred.append("und")
                    score.append(0.0)
                    spans.append([])
                    continue
                weight = np.bincount(path, weights=usable[c], minlength=len(names))
                best = int(weight.argmax())
                pred.append(names[best])
                score.append(float(weight[best] / total))
                if with_spans:
                    starts = np.flatnonzero(np.diff(path, prepend=-1))
                    ends = [*starts[1:], len(path)]
                    spans.append(
                        [{"lang": names[path[a]], "first": int(a), "words": int(b - a)} for a, b in zip(starts, ends, strict=True)]
                    )
            columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            return [*columns, pa.array(spans, SPANS)] if with_spans else columns

        return judge

    added = {"lang_pred": "string", "score": "double"}
    if with_spans:
        added["spans"] = "array<struct<lang: string, first: bigint, words: bigint>>"
    # Texts are labelled together, so a slice holds many of them; what it costs is bounded by bytes and cells.
    return with_judgement(docs, id_col, text_col, keep, added, make, slice_rows=4096)


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
