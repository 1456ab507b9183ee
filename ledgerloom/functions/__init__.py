"""Column functions: text, hashing and vectors, all evaluated inside the JVM."""

from ledgerloom.functions.core import bind
from ledgerloom.functions.hashing import content_ref_of, hash_embedding
from ledgerloom.functions.text import token_count, words
from ledgerloom.functions.vectors import cosine_similarity, dot, l2_norm, l2_normalize

__all__ = [
    "bind",
    "content_ref_of",
    "cosine_similarity",
    "dot",
    "hash_embedding",
    "l2_norm",
    "l2_normalize",
    "token_count",
    "words",
]
