"""Whole texts as numbered words, for the operators that work on word sequences."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words are runs of bytes other than these (``bytes.split`` parts at the same six).
BLANKS = b" \t\n\x0b\x0c\r"


def numbered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts in turn, their numbers (equal words share one), and the texts' n+1 offsets; nulls are empty."""
    words: list[bytes] = []
    offsets = [0]
    for text in texts.cast(pa.large_binary()).to_pylist():
        if text:
            words += text.split()
        offsets.append(len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return words, ids, np.array(offsets, np.int64)
