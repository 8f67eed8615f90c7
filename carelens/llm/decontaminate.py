"""Benchmark decontamination with an FM-index per training shard.

Documents are read in shards of bounded size. A shard's words become
integer symbols over the benchmark vocabulary; a word outside it can be in
no occurrence, so maximal runs of vocabulary words, closed by a separator,
are the text that is indexed, with the document position of each symbol
kept beside it. On that text:

* a suffix array (prefix doubling; each separator ranks apart, so suffixes
  are distinct as soon as their runs end),
* its Burrows-Wheeler transform in a wavelet matrix (one bit plane per
  symbol bit with cumulative counts; ``rank`` is vectorised over queries),
* suffix positions sampled at every ``SAMPLE``-th text position.

All windows of all items are searched backward together; occurrences are
located by walking the LF mapping to a sampled suffix; the occurrences are
merged to removal spans per document. Documents never leave their task and
nothing is shuffled.

The windows are the query set. They are sent to the tasks in blocks of at
most ``block_words`` words, one narrow pass over the documents per block,
so what is broadcast has a fixed bound whatever the benchmark's size.

Edge cases: NULL or empty text has no words and is never hit; an item
without words has no window; repeated items count once per item_id row;
repeated documents are handled row by row; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.llm.common import discard, lean, written

WINDOW_WORDS = 10
SHARD_SYMBOLS = 1 << 20
BLOCK_WORDS = 1 << 20
SAMPLE = 8

# Bytes that separate words: ASCII other than 0-9 and a-z (A-Z is lowered first).
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) for b in range(256))
_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in _LOWER
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of ``[0-9a-z]`` and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def item_windows(text: str | None, size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    """Every run of ``size`` words; a shorter item is one window."""
    w = words(text)
    if not w:
        return []
    return [tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]


# --------------------------------------------------------------- FM-index

class WaveletMatrix:
    """Rank over a sequence of small integers, one bit plane per bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.planes: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits = bits
        cur = seq
        for b in range(bits - 1, -1, -1):
            one = ((cur >> b) & 1).astype(np.int32)
            ones_before = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(one, out=ones_before[1:])
            self.planes.append(ones_before)
            self.zeros.append(len(cur) - int(ones_before[-1]))
            cur = np.concatenate([cur[one == 0], cur[one == 1]])

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of ``sym[k]`` before position ``pos[k]``."""
        lo, hi = np.zeros_like(pos), pos.copy()
        for level in range(self.bits):
            bit = (sym >> (self.bits - 1 - level)) & 1
            ones = self.planes[level]
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, self.zeros[level] + lo1, lo - lo1)
            hi = np.where(bit, self.zeros[level] + hi1, hi - hi1)
        return hi - lo

    def access(self, pos: np.ndarray) -> np.ndarray:
        """Symbols at the positions."""
        p, out = pos.copy(), np.zeros_like(pos)
        for level in range(self.bits):
            ones = self.planes[level]
            o = ones[p]
            bit = ones[p + 1] - o
            out = (out << 1) | bit
            p = np.where(bit, self.zeros[level] + o, p - o)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; symbol 0 separates, each 0 apart."""
    n = len(text)
    sep = text == 0
    rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank = new
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        rank = rank * (n + 1) + second
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Backward search and locate over one shard of symbols (0 separates)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(text)
        n = len(text)
        bwt = text[sa - 1].astype(np.int64)  # the text ends with a separator, so it wraps
        self.n, self.sample = n, sample
        self.wm = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.first[1:])
        # The first position of a run is always sampled: no walk crosses a separator.
        marked = (sa % sample == 0) | (bwt == 0)
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = sa[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``patterns`` (right-aligned)."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            sym = patterns[live, width - k]
            lo[live] = self.first[sym] + self.wm.rank(sym, lo[live])
            hi[live] = self.first[sym] + self.wm.rank(sym, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by LF steps to a sampled suffix."""
        pos, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, cur = np.arange(len(rows)), rows.copy()
        while len(todo):
            before, after = self.mark_rank[cur], self.mark_rank[cur + 1]
            hit = after > before
            pos[todo[hit]] = self.sampled[before[hit]] + steps[todo[hit]]
            todo, cur = todo[~hit], cur[~hit]
            steps[todo] += 1
            sym = self.wm.access(cur)
            cur = self.first[sym] + self.wm.rank(sym, cur)
        return pos


# ------------------------------------------------------------ query blocks

class QueryBlock:
    """Windows of some items as symbol rows, with the items of each window."""

    def __init__(self, rows: list[tuple[str | None, str | None]], size: int):
        vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.items: list[str | None] = []
        for item_id, text in rows:
            ws = item_windows(text, size)
            if not ws:
                continue
            k = len(self.items)
            self.items.append(item_id)
            for w in ws:
                windows.setdefault(tuple(vocab.setdefault(x, len(vocab) + 1) for x in w), set()).add(k)
        self.vocab = vocab
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        self.patterns = np.zeros((len(windows), size), np.int64)
        for r, w in enumerate(windows):
            self.patterns[r, size - len(w):] = w
        self.of_window = [np.array(sorted(s), np.int64) for s in windows.values()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_words: int) -> Iterator[QueryBlock]:
    """Items in blocks of at most ``block_words`` words (or one longer item)."""
    rows, total = [], 0
    source = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for r in source.toLocalIterator():
        n = len(words(r["t"]))
        if rows and total + n > block_words:
            yield QueryBlock(rows, size)
            rows, total = [], 0
        rows.append((r["i"], r["t"]))
        total += n
    yield QueryBlock(rows, size)


def _shard_hits(block: QueryBlock, docs: list[np.ndarray]):
    """(doc index, first word, words, window) of every occurrence in a shard."""
    if not docs or not block.shortest:
        return
    size = np.array([len(d) for d in docs], np.int64)
    start_of = np.cumsum(size + 1) - size - 1  # one separator after every document
    syms = np.zeros(int(size.sum()) + len(docs), np.int64)
    for d, at in zip(docs, start_of.tolist(), strict=True):
        syms[at:at + len(d)] = d
    edge = np.flatnonzero(np.diff(np.concatenate([[False], syms > 0]).astype(np.int8)))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    long_enough = length >= block.shortest
    begin, length = begin[long_enough], length[long_enough] + 1  # with its separator
    if not len(begin):
        return
    shift = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(shift, length) + np.repeat(begin, length)
    text = syms[at]
    owner = np.searchsorted(start_of, at, side="right") - 1
    where = at - start_of[owner]
    fm = FMIndex(text, len(block.vocab))
    lo, hi = fm.search(block.patterns, block.lengths)
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    # Suffix ranks of all occurrences, in pieces so that frequent windows stay bounded.
    start = 0
    while start < len(found):
        end = start + max(1, int(np.searchsorted(np.cumsum(counts[start:]), SHARD_SYMBOLS)))
        c = counts[start:end]
        win = np.repeat(found[start:end], c)
        rank = np.arange(len(win)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[found[start:end]], c)
        hit = fm.locate(rank)
        yield owner[hit], where[hit], block.lengths[win], win
        start = end


def _search_shard(block: QueryBlock, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Merged spans and item numbers for each document of a shard."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[int]] = [set() for _ in docs]
    cover: dict[int, np.ndarray] = {}
    for owner, first, length, win in _shard_hits(block, docs):
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for grp in np.split(order, cuts):
            d = int(owner[grp[0]])
            diff = cover.setdefault(d, np.zeros(len(docs[d]) + 1, np.int64))
            np.add.at(diff, first[grp], 1)
            np.add.at(diff, first[grp] + length[grp], -1)
            for w in np.unique(win[grp]):
                items[d].update(block.of_window[w].tolist())
    for d, diff in cover.items():
        hit = np.cumsum(diff) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
        spans[d] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return [(s, sorted(i)) for s, i in zip(spans, items, strict=True)]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


#: Columns that a search adds: words, merged word spans, items.
NAMES = ("n_words", "spans", "items")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window_words: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
    shard_symbols: int = SHARD_SYMBOLS,
    names: tuple[str, str, str] = NAMES,
    remove: bool = False,
) -> DataFrame:
    """``docs`` plus its number of words, merged word spans and items found, under ``names``.

    Any columns of these names in ``docs`` are replaced. Spans and items are empty
    arrays, never NULL; a NULL item id is reported as NULL. The benchmark is
    taken block by block: the driver and the tasks hold one block at a time, and
    what a block found is written before the next is searched. With ``remove`` the
    last pass also cuts the spans out of the texts (the columns still tell what was found).
    """
    base = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    out = docs.select(*base).withColumns({
        names[0]: F.lit(0).cast("long"),
        names[1]: F.array().cast(_SPANS),
        names[2]: F.array().cast("array<string>"),
    })
    blocks = _blocks(benchmark, item_col, item_text_col, window_words, block_words)
    block, before = next(blocks), None
    while True:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        block = next(blocks, None)
        search = _searcher(shared, text_col, base, shard_symbols, names)
        out = out.mapInArrow(lean(_both(search, _remover(text_col, names[1])) if remove and block is None else search), out.schema)
        if block is None:
            return out
        out = written(out, "contamination")
        shared.unpersist()
        if before is not None:
            discard(before)
        before = out


def _searcher(shared, text_col: str, base: list[str], shard_symbols: int, added: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shared.value
        lookup = block.vocab.get
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            n_words, found, shard, size = [], [], [], 0
            for x in texts:
                w = words(x.as_py())
                n_words.append(len(w))
                syms = np.fromiter(map(lookup, w, repeat(0)), np.int64, len(w))
                shard.append(syms)
                size += len(syms)
                if size >= shard_symbols:
                    found += _search_shard(block, shard)
                    shard, size = [], 0
            found += _search_shard(block, shard)
            names = batch.schema.names
            old_s, old_i = (batch.column(names.index(c)) for c in added[1:])
            spans, items = [], []
            for k, (s, i) in enumerate(found):
                prev_s, prev_i = old_s[k].as_py(), old_i[k].as_py()
                s = [{"start": a, "end": b} for a, b in s]
                spans.append(_merge(prev_s + s) if prev_s and s else prev_s + s)
                items.append(prev_i + [block.items[j] for j in i])
            cols = [batch.column(names.index(c)) for c in base]
            cols += [
                pa.array(n_words, pa.int64()),
                pa.array(spans, batch.schema.field(added[1]).type),
                pa.array(items, batch.schema.field(added[2]).type),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return run


def _merge(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def digest(found: DataFrame) -> DataFrame:
    """Per document: words, hit words, items and their digest."""
    ids = F.array_sort(F.array_distinct(F.col("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _both(first, then):
    """Two task functions in one worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(first(batches))
    return run


def _remover(text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = []
            for x, sp in zip(batch.column(place), batch.column(batch.schema.get_field_index(spans_col)), strict=True):
                t, sp = x.as_py(), sp.as_py()
                if t and sp:
                    at = [m.span() for m in word.finditer(t)]
                    keep, last = [], 0
                    for s in sp:
                        keep.append(t[last:at[s["start"]][0]])
                        last = at[s["end"] - 1][1]
                    t = "".join([*keep, t[last:]])
                texts.append(t)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
    return run


def remove_spans(found: DataFrame, text_col: str = "text", added: tuple[str, str, str] = NAMES) -> DataFrame:
    """Cut the hit words, and what stands between them, out of the text.

    A document that loses every word is left with an empty text. The columns
    that the search added are dropped.
    """
    return found.mapInArrow(lean(_remover(text_col, added[1])), found.schema).drop(*added)


def sha_items(ids: list[str]) -> str:
    """The digest of :func:`digest` for a plain list of ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
