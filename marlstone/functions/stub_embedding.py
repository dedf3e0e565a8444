"""A deterministic stand-in for an embedding model: digests of the text, read as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 1024
_A_DIGEST = 8


def stub_embedding(text: Column, dims: int = DIMS) -> Column:
    """``dims`` doubles in [-1, 1]; ``dims`` is a multiple of 8, null stays null.

    Digest k is the SHA-256 of the text's UTF-8 bytes and k as two big-endian
    bytes; its eight big-endian 32-bit parts are scaled to the range.
    """
    count = F.sequence(F.lit(0), F.lit(dims // _A_DIGEST - 1))
    digest = lambda k: F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lpad(F.hex(k), 4, "0"))), 256)
    part = lambda h: F.array(*[F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("double") for j in range(_A_DIGEST)])
    parts = F.flatten(F.transform(F.transform(count, digest), part))
    return F.when(text.isNotNull(), F.transform(parts, lambda u: u / F.lit(float(0xFFFFFFFF)) * 2 - 1))
