"""Counting the grams of documents, some documents at a time, in Arrow and NumPy.

Tokens become numbers by a dictionary of the documents at hand, a bigram the number of its
pair of tokens; one sort of (document, gram) numbers then counts every gram of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENS = 1 << 19  # counted at a time, but a document whole


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``TOKENS`` tokens, one row at least."""
    ends, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + TOKENS, side="right")))
        yield begin, end
        begin = end


def _keys(lengths: np.ndarray, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, gram) numbers without order, and what a gram number is: below the length of the kinds a token."""
    coded = tokens.dictionary_encode()
    kinds, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = len(kinds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    pair = np.flatnonzero(row[1:] == row[:-1])
    return np.concatenate([row, row[pair]]), np.concatenate([code, n + code[pair] * n + code[pair + 1]]), kinds


def _words(gram: np.ndarray, kinds: pa.Array) -> pa.Array:
    n = len(kinds)
    two = gram >= n
    first, second = np.divmod(gram[two] - n, n)
    joined = pc.binary_join_element_wise(kinds.take(pa.array(first)), kinds.take(pa.array(second)), " ")
    # Places of the words in tokens and bigrams, one array after the other.
    return pa.concat_arrays([kinds, joined]).take(pa.array(np.where(two, n + np.cumsum(two) - 1, gram)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """First columns, numbers of tokens and tokens of some documents at a time."""
    for batch in batches:
        toks = batch.column("_toks")
        lengths = np.nan_to_num(pc.list_value_length(toks).to_numpy(zero_copy_only=False)).astype(np.int64)
        start = np.cumsum(lengths) - lengths
        tokens = pc.list_flatten(toks)
        for a, b in _pieces(lengths):
            if size := int(lengths[a:b].sum()):
                yield batch.column(0).slice(a, b - a), lengths[a:b], tokens.slice(int(start[a]), size)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, word, tf_count`` of ``id, _toks``: a row per document and gram (tokens, and two adjacent ones)."""
    for ids, lengths, tokens in _runs(batches):
        row, gram, kinds = _keys(lengths, tokens)
        width = len(kinds) * (len(kinds) + 1)
        key, tf = np.unique(row * width + gram, return_counts=True)
        row, gram = np.divmod(key, width)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), _words(gram, kinds), pa.array(tf.astype(np.int64))],
                                         ["id", "word", "tf_count"])


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, df`` of ``_toks``: how many of the documents at hand hold each gram."""
    for _, lengths, tokens in _runs(batches):
        row, gram, kinds = _keys(lengths, tokens)
        width = len(kinds) * (len(kinds) + 1)
        gram, df = np.unique(np.unique(row * width + gram) % width, return_counts=True)
        yield pa.RecordBatch.from_arrays([_words(gram, kinds), pa.array(df.astype(np.int64))], ["word", "df"])
