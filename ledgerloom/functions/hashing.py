"""Hash-based content references and deterministic embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.core import as_column
from ledgerloom.functions.vectors import l2_normalize

# Fixed value: how content references start.
CONTENT_REF_PREFIX = "fake-file-"


def content_ref_of(data: Column | str) -> Column:
    """Reference derived from bytes alone: equal bytes give equal references."""
    return F.concat(F.lit(CONTENT_REF_PREFIX), F.substring(F.sha2(as_column(data), 256), 1, 16))


def hash_embedding(text: Column | str, dim: int = 16) -> Column:
    """Unit vector of ``dim`` doubles derived from the text's SHA-256 digests.

    Digest ``c`` covers the UTF-8 bytes followed by ``c`` as four big-endian bytes; each group of
    four digest bytes becomes one value in [-1, 1).
    """
    if dim < 1:
        raise ValueError("dimension must be >= 1")
    raw = as_column(text).cast("binary")
    digests = F.transform(
        F.sequence(F.lit(0), F.lit((dim + 7) // 8 - 1)),
        lambda c: F.sha2(F.concat(raw, F.unhex(F.lpad(F.hex(c), 8, "0"))), 256),
    )
    values = F.flatten(
        F.transform(
            digests,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(7)),
                lambda j: F.conv(F.substr(h, j * 8 + 1, F.lit(8)), 16, 10).cast("double")
                / F.lit(2.0**32)
                * 2
                - 1,
            ),
        )
    )
    return l2_normalize(F.slice(values, 1, dim))
