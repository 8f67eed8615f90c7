"""Removal of repeated byte strings with suffix arrays by induced sorting.

Every byte covered by a ``WIDTH``-byte string that starts anywhere else too
is removed. Strings are judged on the input and never cross documents.

1. **Blocks.** Each window of ``WIDTH`` bytes has an anchor, the ``GRAM``-byte
   string in it of least hash (the leftmost of equals), which depends on the
   window's bytes alone. Windows in a row with one anchor form a block. Equal
   windows have equal anchors, so only blocks that share an anchor matter.
2. **Sift.** Blocks are grouped by anchor (counts and digests only). An anchor
   that occurs once has no repeated window; equal blocks repeat all of theirs.
   What is left are anchors with several different blocks; one copy of each
   such block is cut from the texts.
3. **Suffix arrays.** Blocks are dealt to shards by anchor. A shard joins them,
   each closed by a separator of its own, and builds its suffix array by
   induced sorting: suffixes are classified, leftmost-smaller substrings
   sorted by one induction and named, the named string is sorted in the same
   way, recursively, and a second induction from it fills the array. Of the
   bytes, inductions go bucket by bucket, whole batches at a time; named
   strings, a third as long and of many symbols, place by place. Permuted
   common prefixes come from the irreducible ones; a place whose prefix reaches ``WIDTH`` is repeated, and
   so is its neighbour.
4. **Hot anchors.** An anchor with more than ``HOT_BLOCKS`` different blocks does
   not go to one shard: its windows are grouped by their 128-bit digests.
5. **Cut.** Repeated windows become byte spans per document, and the texts are
   read once more to remove them.

Edge cases: NULL and empty texts have no bytes and keep none; texts below
``WIDTH`` bytes are kept whole; texts of any length are read in stretches;
rows of equal id and text repeat each other; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import lean, written

WIDTH = 400
GRAM = 128  # a power of two
STRETCH = 1 << 21
SHARD_BYTES = 1 << 21
HOT_BLOCKS = 3000

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_ODD = [np.uint64(xxhash.xxh3_64_intdigest(b"m%d" % k) | 1) for k in range(64)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# ----------------------------------------------------------------- blocks

def gram_hashes(b: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, by doubling."""
    h, width = _BYTE[b], 1
    if seed:
        h = _scramble(h ^ _ODD[seed])
    parts, left = None, size
    at = 0
    while left:
        if left & 1:
            piece = h
            if parts is None:
                parts, at = piece, width
            else:
                n = len(b) - at - width + 1
                parts = parts[:max(n, 0)] * _ODD[40 + at.bit_length()] + piece[at:at + max(n, 0)]
                at += width
        left >>= 1
        if left:
            h = h[:len(h) - width] * _ODD[1 + width.bit_length()] + h[width:]
            width *= 2
    return _scramble(parts)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def blocks_of(segments: list[bytes]) -> tuple[np.ndarray, ...]:
    """segment, first window, windows, anchor of every block of the segments."""
    size = np.array([len(s) for s in segments], np.int64)
    end = np.cumsum(size)
    raw = np.frombuffer(b"".join(segments), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < WIDTH:
        return none, none, none, none
    h = gram_hashes(raw, GRAM)
    place = np.uint64((1 << 24) - 1)
    key = (_scramble(h ^ _ODD[50]) & ~place) | np.arange(len(h), dtype=np.uint64)
    anchor_at = (sliding_least(key, WIDTH - GRAM + 1) & place).astype(np.int64)
    starts = np.arange(len(anchor_at))
    seg = np.searchsorted(end, starts, side="right")
    inside = starts + WIDTH <= end[seg]
    starts, anchor_at, seg = starts[inside], anchor_at[inside], seg[inside]
    if not len(starts):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (anchor_at[1:] != anchor_at[:-1]) | (seg[1:] != seg[:-1])]))
    count = np.diff(np.append(new, len(starts)))
    seg = seg[new]
    return seg, starts[new] - (end - size)[seg], count, h[anchor_at[new]].view(np.int64)


def _segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Stretches of a text that hold each of its windows once."""
    for at in range(0, max(1, len(raw) - WIDTH + 1), STRETCH):
        yield at, raw[at:at + STRETCH + WIDTH - 1]


def _bytes(x) -> bytes:
    t = x.as_py()
    return t.encode("utf-8", "surrogatepass") if t else b""


_BLOCKS = "anchor long, digest long, doc_id long, tkey long, first long, windows int"


def _find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def flush(segs, owner, offset, batch):
        seg, first, count, anchor = blocks_of(segs)
        owner, offset = np.array(owner, np.int64), np.array(offset, np.int64)
        digest = [xxhash.xxh3_64_intdigest(memoryview(segs[s])[a:a + c + WIDTH - 1]) - (1 << 63)
                  for s, a, c in zip(seg.tolist(), first.tolist(), count.tolist(), strict=True)]
        rows = pa.array(owner[seg])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(digest, pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows),
             pa.array(first + offset[seg]), pa.array(count.astype(np.int32))], names=names)

    for batch in batches:
        segs, owner, offset, size = [], [], [], 0
        for k, x in enumerate(batch.column(2)):
            raw = _bytes(x)
            if len(raw) < WIDTH:
                continue
            for at, s in _segments(raw):
                segs.append(s)
                owner.append(k)
                offset.append(at)
                size += len(s)
                if size >= STRETCH:
                    yield flush(segs, owner, offset, batch)
                    segs, owner, offset, size = [], [], [], 0
        if segs:
            yield flush(segs, owner, offset, batch)


# ----------------------------------------------------------- suffix array

def _suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as such."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    place = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(place[::-1])[::-1]
    small = np.ones(n, bool)
    known = nxt < n
    small[:-1][known] = step[nxt[known]] > 0
    return small


def _deal(sa: np.ndarray, ends: np.ndarray, pos: np.ndarray, ch: np.ndarray, sign: int) -> None:
    """Append positions, in order, to the open ends of their buckets."""
    order = np.argsort(ch, kind="stable")
    c = ch[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    length = np.diff(np.append(first, len(c)))
    within = np.arange(len(c)) - np.repeat(first, length)
    sa[ends[c] + sign * within] = pos[order]
    ends[c[first]] += sign * length


def _induce(t: np.ndarray, small: np.ndarray, n_sep: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones given in order.

    Symbols below ``n_sep`` are separators, one place each; the others are
    bytes above them. Each bucket is worked in batches: what it holds, then
    what these added to the bucket itself, until nothing is added.
    """
    n = len(t)
    sa = np.full(n, -1, np.int32)
    byte = np.maximum(t - n_sep, -1).astype(np.int16)  # -1: separator
    count = np.bincount(byte[byte >= 0], minlength=256)
    head = n_sep + np.cumsum(count) - count
    tail = head + count - 1
    sep = np.flatnonzero(byte < 0)
    sep = sep[np.argsort(t[sep])]
    used = np.flatnonzero(count)
    own = lms[byte[lms] >= 0]
    own_first = np.searchsorted(byte[own], np.arange(257))

    def before(pos, kind):
        p = pos[pos > 0] - 1
        return p[(small[p] == kind) & (byte[p] >= 0)]

    open_at = head.copy()
    p = before(sep, False)
    if len(p):
        _deal(sa, open_at, p, byte[p], 1)
    for c in used:
        lo = head[c]
        while lo < open_at[c]:
            hi = open_at[c]
            p = before(sa[lo:hi], False)
            if len(p):
                _deal(sa, open_at, p, byte[p], 1)
            lo = hi
        p = before(own[own_first[c]:own_first[c + 1]], False)
        if len(p):
            _deal(sa, open_at, p, byte[p], 1)
    larger_end = open_at.copy()  # where the larger-than-next suffixes of a bucket end
    open_at = tail.copy()
    for c in used[::-1]:
        hi = tail[c]
        while hi > open_at[c]:
            lo = open_at[c]
            p = before(sa[lo + 1:hi + 1][::-1], True)
            if len(p):
                _deal(sa, open_at, p, byte[p], -1)
            hi = lo
        p = before(sa[head[c]:larger_end[c]][::-1], True)
        if len(p):
            _deal(sa, open_at, p, byte[p], -1)
    sa[:n_sep] = sep
    return sa


def _named(t: np.ndarray, lms: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """The rank of each leftmost-smaller substring, equal ones alike, in text order."""
    length = np.ones(len(t), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = by_substring[:-1], by_substring[1:]
    differ = length[a] != length[b]
    alive = np.flatnonzero(~differ)
    k = 0
    while len(alive):
        alive = alive[length[a[alive]] > k]
        apart = t[a[alive] + k] != t[b[alive] + k]
        differ[alive[apart]] = True
        alive = alive[~apart]
        k += 1
    name = np.empty(len(t), np.int64)
    name[by_substring] = np.concatenate([[0], np.cumsum(differ)])
    return name[lms]


def _induce_named(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As :func:`_induce`, for a string of any number of symbols, place by place."""
    count = np.bincount(t)
    ends = np.cumsum(count)
    order = np.argsort(t[lms], kind="stable")
    c = t[lms][order]
    filled = np.full(len(t), -1, np.int64)
    filled[ends[c] - np.searchsorted(c, c, side="right") + np.arange(len(c))] = lms[order]
    # The symbol before each place, where it begins a suffix of the wanted kind; an open place (-1) has none.
    before = np.concatenate([[-1], t[:-1], [-1]])
    kind = np.concatenate([[False], small[:-1], [False]])
    larger, smaller = np.where(kind, -1, before).tolist(), np.where(kind, before, -1).tolist()
    sa, head, tail = filled.tolist(), (ends - count).tolist(), (ends - 1).tolist()
    for p in sa:  # sees what it has itself put further on
        c = larger[p]
        if c >= 0:
            sa[head[c]] = p - 1
            head[c] += 1
    for p in reversed(sa):
        c = smaller[p]
        if c >= 0:
            sa[tail[c]] = p - 1
            tail[c] -= 1
    return np.array(sa, np.int64)


def sort_named(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order, by induced sorting; recursive, linear."""
    if len(np.unique(names)) == len(names):
        return np.argsort(names)
    t = np.append(names.astype(np.int64) + 1, 0)  # closed by a symbol below all
    small = _suffix_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    once = _induce_named(t, small, lms)
    named = _named(t, lms, once[is_lms[once]])
    return _induce_named(t, small, lms[sort_named(named)])[1:]


def suffix_array(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The joined symbols of the blocks, and their suffix array."""
    n_sep = len(blocks)
    size = np.array([len(b) for b in blocks], np.int64)
    closing = np.cumsum(size + 1) - 1
    t = np.empty(int(closing[-1]) + 1, np.int32)
    is_sep = np.zeros(len(t), bool)
    is_sep[closing] = True
    t[is_sep] = np.arange(n_sep)
    t[~is_sep] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int32) + n_sep
    small = _suffix_types(t)
    small[closing] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # Leftmost-smaller places, by first symbol, induce the order of their substrings.
    sorted_once = _induce(t, small, n_sep, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    named = _named(t, lms, sorted_once[is_lms[sorted_once]].astype(np.int64))
    return t, _induce(t, small, n_sep, lms[sort_named(named)])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of each place with its predecessor in the array, and that predecessor.

    Only irreducible places are compared; the others follow, one less each.
    """
    n = len(t)
    pred = np.full(n, -1, np.int64)
    pred[sa[1:]] = sa[:-1]
    left = np.where(np.arange(n) > 0, t[np.arange(n) - 1], -1)
    left_of_pred = np.where(pred > 0, t[pred - 1], -2)
    irreducible = np.flatnonzero((left != left_of_pred) & (pred >= 0))
    pad = np.concatenate([t, np.full(4, -1, t.dtype)]).astype(np.int64) & 0xFFFF
    four = pad[:n] | (pad[1:n + 1] << 16) | (pad[2:n + 2] << 32) | (pad[3:n + 3] << 48)
    # Positions past the end differ from all others: no place is compared beyond its separator.
    common = np.zeros(n, np.int64)
    i, j = irreducible, pred[irreducible]
    k = 0
    while len(i):
        same = four[i + k] == four[j + k]
        end_i, end_j = i[~same], j[~same]
        extra = np.zeros(len(end_i), np.int64)
        more = np.ones(len(end_i), bool)
        for e in range(3):
            more &= pad[end_i + k + e] == pad[end_j + k + e]
            extra += more
        common[end_i] = k + extra
        i, j = i[same], j[same]
        k += 4
    reach = np.full(n, -1, np.int64)
    reach[irreducible] = common[irreducible] + irreducible
    plcp = np.maximum.accumulate(reach) - np.arange(n)
    plcp[pred < 0] = 0
    return np.maximum(plcp, 0), pred


def repeated_places(blocks: list[bytes], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each block, the ranges of places whose ``width`` bytes occur again among the blocks."""
    t, sa = suffix_array(blocks)
    plcp, pred = permuted_prefixes(t, sa)
    hit = plcp >= width
    mark = hit.copy()
    mark[pred[hit]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    start = np.cumsum([0] + [len(b) + 1 for b in blocks])
    out: list[list[tuple[int, int]]] = [[] for _ in blocks]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(np.searchsorted(start, a, side="right")) - 1
        out[k].append((a - int(start[k]), b - int(start[k])))
    return out


# ------------------------------------------------------------------ tasks

_RANGES = "anchor long, digest long, low int, high int"


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of blocks; rows come by anchor, a shard holds whole anchors."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def search():
        found = repeated_places([h[2] for h in held])
        rows = [(h[0], h[1], a, b) for h, r in zip(held, found, strict=True) for a, b in r]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=["anchor", "digest", "low", "high"])

    for batch in batches:
        for a, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and a != held[-1][0] and (size >= SHARD_BYTES or len(held) >= 30_000):
                yield search()
                held, size = [], 0
            held.append((a, d, x.as_py()))
            size += len(held[-1][2])
    if held:
        yield search()


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted blocks of each text."""
    for batch in batches:
        for x, w in zip(batch.column(0), batch.column(1), strict=True):
            raw, rows = _bytes(x), w.as_py()
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["anchor"] for r in part], pa.int64()),
                     pa.array([r["digest"] for r in part], pa.int64()),
                     pa.array([raw[r["first"]:r["first"] + r["windows"] + WIDTH - 1] for r in part], pa.binary())],
                    names=["anchor", "digest", "bytes"])


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit digest of every window of a block."""
    names = ["anchor", "digest", "low", "w1", "w2"]
    for batch in batches:
        for a, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = memoryview(x.as_py())
            n = len(raw) - WIDTH + 1
            both = [xxhash.xxh3_128_intdigest(raw[i:i + WIDTH]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a] * n, pa.int64()), pa.array([d] * n, pa.int64()), pa.array(range(n), pa.int32()),
                 pa.array([(v >> 64) - (1 << 63) for v in both], pa.int64()),
                 pa.array([(v & ((1 << 64) - 1)) - (1 << 63) for v in both], pa.int64())], names=names)


def remove(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs removed."""
    keep, last, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > last or not runs:
            keep.append(raw[last:a])
            runs += 1
        last = max(last, b)
    return b"".join([*keep, raw[last:]]) if runs else raw, runs


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, s in zip(batch.column(1), batch.column(2), strict=True):
            raw = _bytes(x)
            kept, runs = remove(raw, [(r["start"], r["end"]) for r in s.as_py() or []])
            out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        n, r, s, h = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()),
             pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


# --------------------------------------------------------------- operator

def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed texts (``doc_id, tkey, t``), and ``doc_id, tkey, spans`` where any byte is repeated."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), F.col(text_col).alias("t"))
    found = written(keyed.mapInArrow(lean(_find_blocks), _BLOCKS), "repeat-blocks")
    shared = written(found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("n > 1")
        .select("anchor", (F.col("d0") == F.col("d1")).alias("alike")), "repeat-anchors")
    several = written(found.join(shared, "anchor"), "repeat-shared")

    different = several.where(~F.col("alike")).groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "first", "windows")).alias("at"))
    different = written(different, "repeat-different")
    hot = different.groupBy("anchor").agg(F.count("*").alias("n_blocks")).where(F.col("n_blocks") > HOT_BLOCKS) \
        .select("anchor", F.lit(True).alias("hot"))
    wanted = (different.join(hot, "anchor", "left").select("anchor", "digest", "hot", "at.*")
              .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "digest", "first", "windows")).alias("w")))
    k = wanted.withColumnsRenamed({"doc_id": "kd", "tkey": "kt"})
    texts = keyed.join(k, keyed["doc_id"].eqNullSafe(k["kd"]) & (keyed["tkey"] == k["kt"]))
    cut = written(texts.select("t", "w").mapInArrow(lean(_cut_blocks), "anchor long, digest long, bytes binary")
                  .join(hot, "anchor", "left"), "repeat-bytes")

    plain = cut.where("hot is null").select("anchor", "digest", "bytes").dropDuplicates(["anchor", "digest"])
    by_array = plain.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_search_shards), _RANGES)
    windows = cut.where("hot").select("anchor", "digest", "bytes").dropDuplicates(["anchor", "digest"]) \
        .mapInArrow(lean(_window_digests), "anchor long, digest long, low int, w1 long, w2 long")
    windows = written(windows, "repeat-windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    by_digest = windows.join(twice, ["w1", "w2"]).select("anchor", "digest", "low", (F.col("low") + 1).alias("high"))
    ranges = written(by_array.unionAll(by_digest), "repeat-ranges")

    whole = several.where("alike").select("doc_id", "tkey", "first", F.lit(0).alias("low"), F.col("windows").alias("high"))
    copies = different.where("n > 1").select("anchor", "digest", F.lit(0).alias("low"), F.col("at.windows").alias("high"))
    placed = several.where(~F.col("alike")).join(ranges.unionAll(copies), ["anchor", "digest"]).select(
        "doc_id", "tkey", "first", "low", "high")
    spans = (whole.unionAll(placed).select(
        "doc_id", "tkey", (F.col("first") + F.col("low")).alias("start"),
        (F.col("first") + F.col("high") - 1 + WIDTH).alias("end"))
        .groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    return keyed, spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    keyed, spans = repeated_spans(docs, id_col, text_col)
    s = spans.withColumnsRenamed({"doc_id": "sd", "tkey": "st"})
    both = keyed.join(s, keyed["doc_id"].eqNullSafe(s["sd"]) & (keyed["tkey"] == s["st"]), "left")
    return (both.select("doc_id", "t", "spans").mapInArrow(lean(_cut_spans), "doc_id long, " + _RESULT)
            .withColumnRenamed("doc_id", id_col))
