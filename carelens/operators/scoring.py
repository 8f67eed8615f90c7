"""Scoring a cell of retrieval: some queries against some documents of one block.

A cell is one Arrow table of sparse rows, ``qid`` or ``doc_id`` set, with ``terms`` and
``weights``. Every query of it is scored against every document of it, in 64-bit floats:
terms that many of both sides hold as a matrix product, the others by their postings.
Nothing is kept per pair but a batch of queries' scores; ``k`` rows leave per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORES = 1 << 20   # scores held at a time
PRODUCTS = 1 << 20  # products of postings held at a time
GAIN = 200         # a product over postings costs about this many of a matrix product
MATRIX_TERMS = 1024  # at most
PLACES = 1e6       # similarities are ranked after rounding to six places


def _flat(rows: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the row, term and weight of every entry."""
    lengths = pc.list_value_length(rows["terms"]).to_numpy()
    return (np.repeat(at, lengths), pc.list_flatten(rows["terms"]).to_numpy(), pc.list_flatten(rows["weights"]).to_numpy())


def _summed(place: np.ndarray, weight: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Entries of one place add up: an id may come with the same term twice."""
    return np.bincount(place, weight, minlength=shape[0] * shape[1]).reshape(shape)


class _Documents:
    """The documents of a cell, by the rank of their id, for a set of queries."""

    def __init__(self, rows: pa.Table, q_terms: np.ndarray, n_queries: int):
        rank = pc.rank(rows["doc_id"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        _, first = np.unique(rank, return_index=True)
        self.ids, self.n = rows["doc_id"].take(pa.array(first)), len(first)
        doc, term, weight = _flat(rows, rank)
        self.terms, local = np.unique(term, return_inverse=True)
        size = len(self.terms)
        held = np.bincount(local, minlength=size)
        at, known = self.find(q_terms)
        gain = held.astype(np.float64) * np.bincount(at[known], minlength=size) * GAIN
        common = np.flatnonzero(gain > float(self.n) * n_queries)
        common = common[np.argsort(-gain[common], kind="stable")[:MATRIX_TERMS]]
        self.slot = np.full(size, -1)
        self.slot[common] = np.arange(len(common))
        slot = self.slot[local]
        dense = slot >= 0
        self.matrix = _summed(slot[dense] * self.n + doc[dense], weight[dense], (len(common), self.n))
        order = np.argsort(local[~dense], kind="stable")
        self.post_doc, self.post_weight = doc[~dense][order], weight[~dense][order]
        self.held = np.where(self.slot >= 0, 0, held)
        self.start = np.cumsum(self.held) - self.held

    def find(self, q_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of terms, and whether they are there."""
        if not len(self.terms):
            return np.zeros(len(q_terms), np.int64), np.zeros(len(q_terms), bool)
        at = np.minimum(np.searchsorted(self.terms, q_terms), len(self.terms) - 1)
        return at, self.terms[at] == q_terms

    def scores(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` queries (their entries by row and place of the term) and all documents."""
        slot = self.slot[term]
        dense = slot >= 0
        width = len(self.matrix)
        out = np.zeros((n, self.n))  # by rows, so that ``flat`` is the same memory
        np.matmul(_summed(row[dense] * width + slot[dense], weight[dense], (n, width)), self.matrix, out=out)
        flat = out.reshape(-1)
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        made = np.cumsum(self.held[term])
        begin = 0
        while begin < len(term):
            done = made[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(made, done + PRODUCTS, side="right")))
            t = term[begin:end]
            held = self.held[t]
            i = np.repeat(self.start[t] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            np.add.at(flat, np.repeat(row[begin:end] * self.n, held) + self.post_doc[i],
                      np.repeat(weight[begin:end], held) * self.post_weight[i])
            begin = end
        return out


def best_of_cell(k: int) -> Callable[[pa.Table], pa.Table]:
    """A cell's best ``k`` documents of every query with their unrounded scores: ``qid, doc_id, s``.

    Order: the similarity in six places, then the larger document id; similarities of 0 are left out.
    """

    def score(cell: pa.Table) -> pa.Table:
        is_doc = pc.is_null(cell["qid"])
        asked, rows = cell.filter(pc.invert(is_doc)), cell.filter(is_doc)
        row, term, weight = _flat(asked, np.arange(len(asked)))
        docs = _Documents(rows, term, len(asked))
        at, known = docs.find(term)
        row, at, weight = row[known], at[known], weight[known]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, SCORES // max(1, docs.n))
        for begin in range(0, len(asked) if docs.n else 0, step):
            n = min(step, len(asked) - begin)
            a, b = np.searchsorted(row, (begin, begin + n))
            s = docs.scores(row[a:b] - begin, at[a:b], weight[a:b], n)
            # One number orders by similarity and id; it stays below 2**53.
            key = np.rint(s * PLACES) * docs.n + np.arange(docs.n)
            every = np.arange(n)
            for _ in range(min(k, docs.n)):
                best = key.argmax(axis=1)
                some = key[every, best] >= docs.n
                found.append((every[some] + begin, best[some], s[every[some], best[some]]))
                key[every, best] = -1.0
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"qid": asked["qid"].take(pa.array(q)), "doc_id": docs.ids.take(pa.array(d)), "s": pa.array(s, pa.float64())})

    return score
