"""Loading of tokenizer files, and the split of texts into words that tokenize on their own."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

# Texts of these characters are split here, all others by the library's own rules: every letter is
# its own composed form, and lower case keeps the number of characters.
PLAIN = re.compile("[\x00-\x1b -~À-ÖØ-öø-ÿĀ-įĲ-ſ]*")
# The pre-tokenizer of word_bpe_49k.json on a white-space-free part of such a text in lower case (a fixed value).
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿßā-ſ]+|[0-9]|[^a-zà-öø-ÿßā-ſ0-9]+")
# What word_bpe_49k.json does to a text before its words are merged (fixed values).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
# Distinct chunks and words of one half of a worker's cache, some 40 MB.
CACHE_ENTRIES = 200_000


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file; the driver reads it and sends it along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def bare_specials(spec: dict) -> bool:
    """Whether special strings are found in a text as they stand, before anything else is done to it."""
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    return not any(t.get(f) for t in spec["added_tokens"] for f in flags)


def splits_here(spec: dict) -> bool:
    """Whether :func:`plain_chunks` and ``WORDS`` give the words of this tokenizer file."""
    known = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
    return known and bare_specials(spec) and all("<|" in t["content"] for t in spec["added_tokens"])


def merges_here(spec: dict) -> bool:
    """Whether the file's words are merged from single bytes by rank alone."""
    model, last = spec["model"], spec["pre_tokenizer"] or {}
    last = last["pretokenizers"][-1] if last.get("type") == "Sequence" else last
    bytes_only = last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and bare_specials(spec)
    options = ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback")
    if not bytes_only or model.get("type") != "BPE" or any(model.get(o) for o in options):
        return False
    suffix = model.get("end_of_word_suffix") or ""
    return all(sign in model["vocab"] and sign + suffix in model["vocab"] for sign in byte_signs())


def plain_chunks(text: str) -> list[str] | None:
    """The white-space-separated chunks of a text that needs no library rules; ``None`` for all other texts."""
    return text.lower().split() if "<|" not in text and PLAIN.fullmatch(text) else None


class PerChunk(dict):
    """Values of chunks, computed once per distinct chunk and per distinct word of a chunk.

    ``of_word`` gives a word's value, ``add`` joins a list of values. When ``limit`` entries are held they become the
    older half, from which what is met again is taken over, and the half before is let go; so frequent
    chunks stay, at most twice the limit is held, and no value ever changes.
    """

    def __init__(self, of_word: Callable[[str], object], add: Callable[[list], object], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.of_word, self.add, self.limit = of_word, add, limit
        self.older: dict[str, object] = {}

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            words = WORDS.findall(chunk)
            value = self.of_word(chunk) if len(words) == 1 else self.add([self[w] for w in words])
        self[chunk] = value
        return value

    def of(self, chunks: list[str]):
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        return self.add(list(map(self.__getitem__, chunks)))


def byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself where it prints, else one above 255."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]
