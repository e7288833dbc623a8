"""Suffix-array removal of repeated byte strings.

Null texts count as empty, texts shorter than the length keep all bytes, an empty table gives an empty table, repeated
rows are copies of each other and lose all windows. Columns of the input stay; those that the result adds replace columns
of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from utterlake.llm import spans as S
from utterlake.llm.suffix import longest_matches


def _repeated(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """A window is repeated if its suffix shares `length` symbols with a neighbour in the block's suffix array."""
    return [m[: len(p) - length + 1] >= length for p, m in zip(pieces, longest_matches(pieces, length - 1), strict=True)]


def dedup_bytes(df: DataFrame, text: str = "text", length: int = 200, gram: int = 40, hot: int = 4000, with_text: bool = True) -> DataFrame:
    """Add n_symbols (bytes), n_removed, n_spans, kept_sha256, spans (byte offsets: start, end, ...) and kept_text.

    Each byte inside a string of `length` bytes that also starts elsewhere is removed. kept_text keeps a character of
    which only some bytes are removed; kept_sha256 is that of the bytes that are left.
    """
    new = ("n_symbols", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", "_k1", "_k2")
    clean = df.drop(*[c for c in df.columns if c.lower() in new])
    return S.cut_texts(clean, text, S.Method(False, length, gram, _repeated, hot), with_text)
