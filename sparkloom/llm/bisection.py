"""Recursive graph bisection of documents and terms."""

from __future__ import annotations

import numpy as np

ROUNDS = 12


def _cost(n: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Bits of the gaps of `degree` postings among n documents."""
    return degree * np.log2(np.maximum(n, 1) / (degree + 1.0))


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of documents 0 to n_docs - 1, given the pairs (doc, term), in which those with common terms are near.

    Every part is cut into halves as the order is, then pairs of documents, one of each half, change places while both
    gains together are above 0: a gain is what the postings' gaps cost less. All parts of a level are worked on at once.
    Returns the documents in order, and for each level the half (0 or 1) of each document.
    """
    order, halves = np.arange(n_docs), []
    edges = np.array([0, n_docs])
    for _ in range(levels):
        middle = (edges[:-1] + edges[1:] + 1) // 2
        part_of_place = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        right = np.arange(n_docs) >= middle[part_of_place]  # of a place
        part, place = np.empty(n_docs, dtype=np.int64), np.empty(n_docs, dtype=np.int64)
        part[order] = part_of_place
        n_left, n_right = (middle - edges[:-1])[:, None], (edges[1:] - middle)[:, None]
        shape, cell = (len(edges) - 1, n_terms), part[doc] * n_terms + term
        for _ in range(rounds):
            place[order] = np.arange(n_docs)
            side = right[place]
            of = side[doc]
            lefts = np.bincount(cell[~of], minlength=shape[0] * shape[1]).reshape(shape)
            rights = np.bincount(cell[of], minlength=shape[0] * shape[1]).reshape(shape)
            now = _cost(n_left, lefts) + _cost(n_right, rights)
            to_right = now - _cost(n_left, np.maximum(lefts - 1, 0)) - _cost(n_right, rights + 1)
            to_left = now - _cost(n_left, lefts + 1) - _cost(n_right, np.maximum(rights - 1, 0))
            gain = np.bincount(doc, np.where(of, to_left.ravel()[cell], to_right.ravel()[cell]), n_docs)
            # within each half of each part by gain: the i-th of the left meets the i-th of the right
            order = order[np.lexsort((-gain[order], right, part_of_place))]
            lower = np.flatnonzero(~right)
            other = lower - edges[:-1][part_of_place[lower]] + middle[part_of_place[lower]]
            inside = other < edges[1:][part_of_place[lower]]
            lower, other = lower[inside], other[inside]
            swap = gain[order[lower]] + gain[order[other]] > 1e-9
            if not swap.any():
                break
            a, b = lower[swap], other[swap]
            order[a], order[b] = order[b], order[a]
        place[order] = np.arange(n_docs)
        halves.append(right[place].astype(np.int64))
        edges = np.unique(np.concatenate([edges, middle]))
    return order, halves


class Splitter:
    """The upper cuts of a bisection of some documents, for all others: a document goes where, at each cut, its terms are
    the commoner; at the median of the fitted ones, so both halves get about as many."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int):
        _, halves = bisected(doc, term, n_docs, n_terms, levels)
        self.weights, self.medians = [], []
        node = np.zeros(n_docs, dtype=np.int64)
        for level, half in enumerate(halves):
            shape = (1 << level, n_terms)
            count = lambda own: np.bincount(node[doc[own]] * n_terms + term[own], minlength=shape[0] * shape[1]).reshape(shape)
            of = half[doc] == 1
            weight = (np.log2(count(of) + 1.0) - np.log2(count(~of) + 1.0)).astype(np.float32)
            score = np.bincount(doc, weight[node[doc], term], n_docs)
            median = np.zeros(shape[0])
            for k in range(shape[0]):
                own = score[node == k]
                median[k] = np.median(own) if len(own) else 0
            self.weights.append(weight)
            self.medians.append(median)
            node = 2 * node + (score > median[node])

    def leaves(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        node = np.zeros(n_docs, dtype=np.int64)
        for weight, median in zip(self.weights, self.medians):
            score = np.bincount(doc, weight[node[doc], term], n_docs)
            node = 2 * node + (score > median[node])
        return node
