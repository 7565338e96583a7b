"""Context-tree weighting over bytes: windows of a text, weights and predictions of a range of depths."""

from __future__ import annotations

import numpy as np

#: Parts words; ends a text. No word holds either.
SEPARATOR, END = b" ", b"\n"
#: Bytes of context. A context and the byte after it fill 48 bits, so that a piece's number fits beside them.
DEPTH = 5
PIECES = 1 << 16
HALF = np.log(0.5)


def windows(pieces: list[bytes], befores: list[bytes]) -> np.ndarray:
    """For every byte of the pieces, sorted: the byte and the DEPTH bytes before it, nearest lowest but the byte itself,
    and below these 48 bits the number of the piece. befores: the DEPTH bytes in front of each piece."""
    blob = b"\0\0" + b"".join(x for pair in zip(befores, pieces) for x in pair)
    at = np.ndarray(max(0, len(blob) - 7), dtype=">u8", buffer=blob, strides=(1,)).astype(np.uint64) if len(blob) > 7 else np.zeros(0, dtype=np.uint64)
    # window i ends at byte i + 7 = 2 + DEPTH + i of the blob
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    of = np.repeat(np.arange(len(pieces), dtype=np.uint64), sizes + DEPTH)[DEPTH:]
    own = np.ones(len(of), dtype=bool)
    edges = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    for d in range(DEPTH):  # the bytes in front of later pieces
        own[edges + d] = False
    return np.sort((at[own] << np.uint64(16)) | of[own])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def shortened(key, depth: int):
    """Keys, or a column of them, with only the nearest `depth` bytes of their contexts."""
    mask = (1 << (8 * (depth + 1))) - 1
    return key.bitwiseAND(mask) if hasattr(key, "bitwiseAND") else key & mask


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers, by Stirling's series above 8."""
    x, shift = x.astype(np.float64), 0.0
    for _ in range(8):
        low = x < 8
        shift = shift + np.where(low, np.log(x), 0)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def weighted(key: np.ndarray, n: np.ndarray, below: np.ndarray | None, depth: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighting of the depths `depth`, `depth` - 1, ..., `levels` of them, over all rows of some subtrees.

    key: distinct (context of `depth` bytes, byte). n: its occurrences. below: for each of the byte's eight decisions,
    the sum of ln P_w of the context's children at that node of the byte's decomposition; None at the greatest depth.
    Each of the 255 nodes of the decomposition has a context tree of its own, in which a context's weighted probability
    is half its own estimate and half the product of its children's, at the greatest depth its own.

    Returns a and b, with which a decision's probability at the least depth is a + b * (its probability below); and one
    row for each (context a level above, byte): its key, occurrences and sums of ln P_w.
    """
    a, b = np.zeros((len(key), 8)), np.ones((len(key), 8))
    row = np.arange(len(key))  # of the present level, for each row of the first
    for d in range(depth, depth - levels, -1):
        parents, up = np.unique(shortened(key, d - 1) if d else key * 0, return_inverse=True)
        above = np.zeros((len(parents), 8))
        context, byte = key >> 8, key & 255
        for j in range(8):
            nodes, at, of = np.unique(context << 8 | (byte >> (8 - j) << (8 - j)), return_index=True, return_inverse=True)
            bit = byte >> (7 - j) & 1
            total, ones = np.bincount(of, n, len(nodes)), np.bincount(of, n * bit, len(nodes))
            whole = own = log_kt(total - ones, ones)
            weight = np.ones(len(nodes))
            if below is not None:
                whole = np.logaddexp(own, below[at, j]) + HALF
                weight = np.exp(np.minimum(0, own + HALF - whole))
            share = weight[of]
            estimate = (np.where(bit == 1, ones[of], (total - ones)[of]) + 0.5) / (total[of] + 1)
            a[:, j] = (share * estimate)[row] + (1 - share)[row] * a[:, j]
            b[:, j] *= (1 - share)[row]
            # each child's node counts once in its parent's node
            prefix = lambda k: k >> 8 << 8 | ((k & 255) >> (8 - j) << (8 - j))
            over, place = np.unique(prefix(shortened(nodes, d - 1)) if d else nodes * 0, return_inverse=True)
            above[:, j] = np.bincount(place, whole, len(over))[np.searchsorted(over, prefix(parents) if d else parents)]
        n = np.bincount(up, n, len(parents)).astype(np.int64)
        key, below, row = parents, above, up[row]
    return a, b, key, n, below
