"""The perfect binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within distance 3 of exactly one of the 4096 codewords. ``indices`` gives for a word the
message indices of all codewords within distance 4: one where the nearest is at distance 2 or less, else six.
Two words that differ in at most two bits have an index in common.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from larkspur.sources.shared import per_worker

N, K = 23, 12
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _mod(word: int) -> int:
    for bit in range(N - 1, N - K - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (N - K))
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the high 12 bits by their value; per syndrome six error patterns of weight 4 or less, padded with -1."""
    unit = [_mod(1 << i) for i in range(N)]
    high = np.zeros(1 << K, np.int32)
    for i in range(K):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[i + N - K]
    errors = np.full((1 << (N - K), 6), -1, np.int32)
    used = np.zeros(1 << (N - K), np.int32)
    for weight in range(5):
        for bits in combinations(range(N), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            errors[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return high, errors


def indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word a row of six codeword indices, -1 where there are fewer."""
    high, errors = per_worker("golay", _tables)
    words = words.astype(np.int32)
    syndrome = high[words >> (N - K)] ^ (words & ((1 << (N - K)) - 1))
    found = errors[syndrome]
    return np.where(found < 0, -1, (words[:, None] ^ found) >> (N - K))
