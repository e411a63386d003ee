"""Texts as arrays: code points, letters and character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Code points of texts handled together, but for a longer single text: bounds a task's memory.
CHUNK_CHARS = 1 << 20


def chunks(batches: Iterable[pd.DataFrame], text: str = "text") -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in pieces of about ``CHUNK_CHARS`` characters; null texts become empty."""
    for batch in batches:
        batch = batch.reset_index(drop=True)
        batch[text] = batch[text].fillna("")
        if len(batch) == 0:
            continue
        at = batch[text].str.len().to_numpy().cumsum() // CHUNK_CHARS
        for _, piece in batch.groupby(at, sort=False):
            yield piece.reset_index(drop=True)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a zero before and after each, and where each begins."""
    joined = "\0" + "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return codes, np.concatenate([[1], 1 + lengths.cumsum()[:-1]]) if len(texts) else np.zeros(0, np.int64)


def lower_letters(codes: np.ndarray) -> np.ndarray:
    """The codes with capitals made small and all that is no letter made zero."""
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    small = np.zeros(int(present[-1]) + 1 if len(present) else 1, dtype=np.uint32)
    for c in present.tolist():
        if chr(c).isalpha():
            low = chr(c).lower()
            small[c] = ord(low) if len(low) == 1 else c
    return small[codes]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads near ones apart (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
