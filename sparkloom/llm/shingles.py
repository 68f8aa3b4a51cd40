"""Hashed word shingles of a text, inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Odd multipliers, one to a place in the shingle (from the fractional parts of square roots of primes).
PLACES = [0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1]


def text_words(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case, as bytes; bytes' own split parts at exactly U+0020 and U+0009 to U+000D."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words' shingles; with fewer words than ``width`` the whole sequence is one."""
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    if len(h) < width:
        h = np.concatenate([h, np.full(width - len(h), len(h), np.uint64)])
    n = len(h) - width + 1
    s = h[:n] * np.uint64(PLACES[0])
    for k in range(1, width):
        s = (s ^ (s >> np.uint64(29))) + h[k : k + n] * np.uint64(PLACES[k % 4] + 2 * (k // 4))
    s ^= s >> np.uint64(32)
    return np.unique(s * np.uint64(PLACES[1]))
