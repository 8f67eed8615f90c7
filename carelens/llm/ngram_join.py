"""N-gram Jaccard join by parity sketches.

A document is its set of distinct five-word shingles, hashed to 64 bits;
documents of one set are one class. Two sets link when 100 * intersection
>= 75 * union, that is when their symmetric difference ``d`` is at most a
seventh of the sum of their sizes.

**Sketch.** Shingles are XORed into a bit vector, one bit a shingle, that is
cut into ``2 ** scale`` blocks by the leading hash bits; as each differing
shingle flips one bit, the Hamming distance of two sketches, and so the
number of blocks in which they differ, is at most ``d``. The vector is
wide and sparse, so a block is kept as the XOR of its shingles' digests.

**Pigeonhole per size band.** Each band of sizes has its number of blocks, a
power of two between half and twice the size; a set whose partners may lie in
the next band emits blocks for that band too. Two linked sets agree on all their
non-empty blocks but ``d``, hence share one among the first ``d + 1`` in any
common order. Blocks made of very frequent shingles go last in that order;
any list of frequent shingles gives the same links, so a bounded one is
sent to the tasks. (Small sets take one block a shingle. In the bands above,
more than ``d`` blocks are non-empty but for a chance below 1e-15 a pair.)

**Verify.** Each set is checked, exactly, on shingle sets, against one hub with which it
shares most blocks; verified links make components; sets of blocks that still join several
components are checked, in ``HUB_ROUNDS`` rounds, against the set that stands in most such blocks (the
middle of a group of variants); then every remaining pair that
shares a block and lies in different components is checked as well, after the size bound and
a Hamming bound on 1024-bit sketches (of 8192 bits for sets above ``LONG``). A pair inside
one component needs no check for the component, and no link between components is lost.

**Count** (on request). Links lie inside components. One whose every pair was verified is
counted from these; the sets of any other are dealt to tiles by hash, and each
pair of tiles is a group of bounded size in which all pairs of sets are compared
exactly on their shingles. Only counts leave a group. A component of ``m`` sets sends
``m * m / TILE_SETS`` texts and makes ``m * m / 2`` comparisons.

Blocks shared by exactly the same sets are one block to all that follows.
Rows of one block that a task has already seen are joined to that task's
own hub, so a block shared by a third of all sets sends one row per task
batch to the next stage. Components are found by contraction: later links are
joined to the components found before, not to all sets anew.

Edge cases: NULL and empty texts, and texts without words, have no shingle
and link with nothing; repeated rows and equal texts are one class; rows of
one id are told apart by their text; a component of NULL ids only has a NULL
id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.llm.common import discard, lean, written

SHINGLE = 5
PERCENT = 75
FINE = 64  # sets up to this size take one block a shingle
DENSE = 256  # above it, blocks are half as many as shingles to begin with
HOT_SHINGLES = 1 << 16
HOT_IN_BATCH = 8
CACHE_WORDS = 200_000
CHUNK_SHINGLES = 1 << 20
SKETCH_BITS = 1024
LONG_BITS = 8192  # of the second sketch that sets above LONG shingles have
LONG = 512
TILE_SETS = 256
HUB_ROUNDS = 1
TILE_SHINGLES = 1 << 20

_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_set(text: str | None, cache: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - size + 1)
    total = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        total += h[k:k + n] * _ODD[k % len(_ODD)]
        total = mix(total) if k % len(_ODD) == len(_ODD) - 1 and size > len(_ODD) else total
    return np.unique(mix(total))


def set_class(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


# --------------------------------------------------------------- sketches

def _scale(n: np.ndarray) -> np.ndarray:
    """Blocks of a set size as a power of two; 0 up to FINE. Above DENSE half of what covers it."""
    power = np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64)
    return np.where(n <= FINE, 0, power - (n > DENSE))


def _largest(scale: np.ndarray) -> np.ndarray:
    """The largest set size of a band."""
    return np.where(scale == 0, FINE, np.where((2 << scale) > DENSE, 2 << scale, 1 << scale))


def blocks(sets: list[np.ndarray], hot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the first blocks of every set, and the set of each."""
    n = np.array([len(s) for s in sets], np.int64)
    largest = n * 100 // percent
    own, upper = _scale(n), _scale(largest)
    sig, of = [], []
    for scale, chosen, partner in (
            (own, np.flatnonzero(n > 0), np.minimum(largest, _largest(own))),
            (upper, np.flatnonzero(upper != own), largest)):
        # |difference| <= (1 - t) / (1 + t) * (sum of the sizes)
        d = (n + partner) * (100 - percent) // (100 + percent)
        for start in range(0, len(chosen), 4096):
            part = chosen[start:start + 4096]
            s, o = _blocks_of([sets[k] for k in part], scale[part], d[part] + 1, hot)
            sig.append(s)
            of.append(part[o])
    return np.concatenate(sig), np.concatenate(of)


def _blocks_of(sets: list[np.ndarray], scale: np.ndarray, keep: np.ndarray, hot: np.ndarray):
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shift = np.where(scale == 0, 0, 64 - scale).astype(np.uint64)
    block = tokens >> shift[of]
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(mix(tokens ^ _ODD[1]), first)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        is_hot = np.logical_and.reduceat(hot[at] == tokens, first)
    else:
        is_hot = np.zeros(len(first), bool)
    owner, number = of[first], block[first]
    # Rank inside the set: blocks that are not hot by number, then the hot ones.
    cold = ~is_hot
    upto = np.cumsum(cold)
    start = np.searchsorted(owner, np.arange(len(sets)))
    base = np.concatenate([[0], upto])[start]
    n_cold = np.concatenate([[0], upto])[np.searchsorted(owner, np.arange(len(sets)), side="right")] - base
    cold_rank = upto - 1 - base[owner]
    place = np.arange(len(first)) - start[owner]
    rank = np.where(cold, cold_rank, n_cold[owner] + place - (upto - base[owner]))
    take = rank < keep[owner]
    sig = mix(parity ^ mix(number * _ODD[2] + scale[owner].astype(np.uint64)))
    return sig[take], owner[take]


def sketch(s: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the shingles on ``size`` bits, as 64-bit words."""
    bits = np.bincount((mix(s ^ _ODD[3]) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


# ------------------------------------------------------------------ tasks

def _chunks(batches, text_at: int):
    """Shingle sets of the rows, in chunks of about CHUNK_SHINGLES shingles."""
    cache = WordHashes()
    for batch in batches:
        sets, size, first = [], 0, 0
        for k, x in enumerate(batch.column(text_at)):
            s = shingle_set(x.as_py(), cache)
            sets.append(s)
            size += len(s)
            if size >= CHUNK_SHINGLES:
                yield batch.slice(first, len(sets)), sets
                sets, size, first = [], 0, k + 1
        if sets:
            yield batch.slice(first, len(sets)), sets


_ROWS = "doc_id long, tkey long, n long, cls long, hot long, n_hot long"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; frequent shingles of each chunk besides."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    for rows, sets in _chunks(batches, 2):
        cls = [set_class(s) for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()),
             none, none], names=names)
        distinct = {c: s for c, s in zip(cls, sets, strict=True) if c is not None}
        if distinct:
            tokens, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            often = np.flatnonzero(count >= HOT_IN_BATCH)
            often = often[np.argsort(-count[often], kind="stable")[:4096]]
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(tokens[often].view(np.int64)), pa.array(count[often])], names=names)


def _emit(shared):
    """``sig, cls, hub``: block signatures; the hub is another set of the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for _, sets in _chunks(batches, 0):
            by_class = {set_class(s): s for s in sets if len(s)}
            if not by_class:
                continue
            cls = np.array(sorted(by_class), np.int64)
            sig, of = blocks([by_class[c] for c in cls.tolist()], hot)
            order = np.lexsort((of, sig))
            sig, own = sig[order], cls[of[order]]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            first = np.flatnonzero(new)
            hub = np.repeat(own[first], np.diff(np.append(first, len(sig))))
            shared_here = np.repeat(np.diff(np.append(first, len(sig))) > 1, np.diff(np.append(first, len(sig))))
            for i in range(0, len(sig), 1 << 18):
                s = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[s].view(np.int64)), pa.array(own[s]),
                     pa.array(hub[s], pa.int64(), mask=~shared_here[s])], names=["sig", "cls", "hub"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks shared by two sets or more, each set with a hub; rows come by signature."""
    held = None  # first row of the signature at hand: sig, cls, whether it is out
    names = ["sig", "cls", "hub"]

    def table(sig, cls, hub):
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array(hub)], names=names)

    for batch in batches:
        sig, cls = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        local = batch.column(2)
        has_local = ~np.asarray(local.is_null())
        hub_in = np.where(has_local, local.fill_null(0).to_numpy(zero_copy_only=False), cls)
        member = hub_in != cls
        if member.any():  # joined in their own chunk already
            yield table(sig[member], cls[member], hub_in[member])
        sig, cls, out = sig[~member], cls[~member], has_local[~member]
        if not len(sig):
            continue
        done = np.zeros(len(sig), bool)
        if held is not None:
            sig, cls = np.append(held[0], sig), np.append(held[1], cls)
            out, done = np.append(held[2] or held[3], out), np.append(held[2], done)
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(sig)))
        hub = np.repeat(cls[first], length)
        several = np.repeat(length > 1, length) | out
        emit = several & ~done
        if emit.any():
            yield table(sig[emit], cls[emit], hub[emit])
        k = first[-1]
        held = (sig[k], cls[k], bool(several[k]), bool(out[k]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and sketch beside each text."""
    for rows, sets in _chunks(batches, 1):
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
             pa.array([sketch(s, LONG_BITS) if len(s) > LONG else None for s in sets], pa.list_(pa.int64()))],
            names=["cls", "t", "n", "sketch", "long_sketch"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of texts whose shingle sets link; equal first texts follow each other."""
    cache = WordHashes()
    last, a = None, None
    for batch in batches:
        ok = []
        for u, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if u != last:
                last, a = u, shingle_set(x.as_py(), cache)
            b = shingle_set(y.as_py(), cache)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            ok.append(100 * common >= PERCENT * (len(a) + len(b) - common))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def linked_copies(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For every set the copies of the sets that it links with.

    Compared are the sets of side 0 with those of side 1; all with each other if there is one side only.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(n) - n
    one_side = side.min() == side.max()
    a, b = (np.flatnonzero((side == k) | one_side) for k in (0, 1))
    b = b[np.argsort(n[b], kind="stable")]
    a = b if one_side else a
    start = np.cumsum(n[b]) - n[b]
    ids_b = np.concatenate([ids[first[j]:first[j] + n[j]] for j in b.tolist()])
    mark = np.zeros(len(ids), np.uint8)
    out = np.zeros(len(sets), np.int64)
    for k, i in enumerate(a.tolist()):
        x = k + 1 if one_side else int(np.searchsorted(n[b], -(-n[i] * percent // 100)))
        y = int(np.searchsorted(n[b], n[i] * 100 // percent, side="right"))
        if x >= y:
            continue
        own = ids[first[i]:first[i] + n[i]]
        mark[own] = 1
        last = start[y - 1] + n[b[y - 1]]
        common = np.add.reduceat(mark[ids_b[start[x]:last]], start[x:y] - start[x], dtype=np.int64)
        mark[own] = 0
        linked = b[x:y][100 * common >= percent * (n[i] + n[b[x:y]] - common)]
        out[i] += copies[linked].sum()
        out[linked] += copies[i]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the classes of each pair of tiles, as documents; the rows of a pair follow each other."""
    cache = WordHashes()
    at, held = None, []  # (class, side, copies, set) of the pair of tiles at hand

    def counted():
        cls, side, copies, sets = zip(*held, strict=True)
        # A pair of two tiles of which one is empty has nothing to compare.
        if at[1] != at[2] and len(set(side)) == 1:
            return
        n = linked_copies(list(sets), np.array(side), np.array(copies, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n)], names=["u", "n"])

    for batch in batches:
        label, lo, hi, cls, tile, copies = (batch.column(k).to_pylist() for k in range(6))
        for k, x in enumerate(batch.column(6)):
            key = (label[k], lo[k], hi[k])
            if key != at:
                if held:
                    yield from counted()
                at, held = key, []
            held.append((cls[k], int(tile[k] != lo[k]), copies[k], shingle_set(x.as_py(), cache)))
    if held:
        yield from counted()


# ------------------------------------------------------------- components

def relabel(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Distinct ``u, v`` with both ends replaced by their labels, without loops."""
    for end in ("u", "v"):
        to = label.select(F.col("node").alias(end), F.col("label").alias("to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def compose(label: DataFrame, more: DataFrame) -> DataFrame:
    """``node, label``: the labels of ``label`` led on through ``more``, and those of its own nodes."""
    onward = more.select(F.col("node").alias("label"), F.col("label").alias("to"))
    led = label.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return led.unionAll(more.join(label, "node", "left_anti").select("node", "label"))


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """``node, label`` for linked nodes: one label, itself a node, to each component.

    Each round hooks every node to its least neighbour, follows the hooks to
    their ends, and contracts the links to what still joins two ends: at most
    half of the nodes that still have links are left.
    """
    edges = written(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
                    f"{name}-edges")
    label = None
    while label is None or not edges.isEmpty():
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionAll(
            edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
        hook = written(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label")), f"{name}-hooks")
        while True:
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("to"))
            led = written(hook.join(up, "label").select("node", F.col("to").alias("label"), (F.col("to") < F.col("label")).alias("moved")),
                          f"{name}-hooks")
            discard(hook)
            hook = led
            if hook.where("moved").isEmpty():
                break
        old_label, old_edges = label, edges
        label = written(hook.select("node", "label") if label is None else compose(label, hook.select("node", "label")), name)
        edges = written(relabel(edges, hook), f"{name}-edges")
        discard(hook, old_edges, *([] if old_label is None else [old_label]))
    return label


def _linked(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs ``u, v`` that link, checked on their whole texts.

    Pairs are few by now (sizes and sketches allow them); those of two long
    sets are held against their longer sketches first. Only texts of classes
    that are in a pair are joined.
    """
    long = texts.where(F.col("long_sketch").isNotNull())
    of_u = long.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("long_sketch").alias("s_u"))
    of_v = long.select(F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("long_sketch").alias("s_v"))
    apart = F.aggregate(F.zip_with("s_u", "s_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    pairs = (pairs.join(of_v, "v", "left").join(of_u, "u", "left")
             .where(F.coalesce(apart <= _most_differences(F.col("n_u"), F.col("n_v")), F.lit(True))).select("u", "v"))
    pairs = written(pairs, f"{name}-pairs")
    asked = pairs.select(F.col("u").alias("cls")).unionAll(pairs.select(F.col("v").alias("cls"))).distinct()
    few = written(texts.select("cls", "t").join(asked, "cls", "left_semi"), f"{name}-texts")
    a = few.select(F.col("cls").alias("u"), F.col("t").alias("text_u"))
    b = few.select(F.col("cls").alias("v"), F.col("t").alias("text_v"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", "text_u", "text_v")
    links = written(both.mapInArrow(lean(_verify), "u long, v long"), f"{name}-links")
    discard(pairs, few)
    return links


def _partners(links: DataFrame, label: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``u, n_partners``: the documents of all other classes that class ``u`` links with."""
    of = label.select(F.col("node").alias("cls"), "label")
    known = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    n_known = known.join(of, F.col("u") == F.col("cls")).groupBy("label").agg(F.count("*").alias("n_known"))
    m = F.count("*")
    sizes = texts.select("cls", "n").join(of, "cls").groupBy("label").agg(
        m.alias("m"), F.ceil(F.greatest(m / TILE_SETS, F.sum("n") / TILE_SHINGLES)).alias("tiles"))
    sizes = sizes.join(n_known, "label").select("label", "tiles", (2 * F.col("n_known") == F.col("m") * (F.col("m") - 1)).alias("all_known"))
    members = written(of.join(sizes, "label").join(classes.select("cls", "n_copies"), "cls"), "ngram-members")

    both = known.unionAll(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.join(members.where("all_known"), F.col("v") == F.col("cls")).select("u", F.col("n_copies").alias("n"))
    dealt = (members.where("not all_known").join(texts.select("cls", "t"), "cls")
             .withColumn("tile", F.pmod(F.xxhash64("cls"), "tiles"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
             .select("label", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
                     "cls", "tile", "n_copies", "t"))
    counted = (dealt.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
               .mapInArrow(lean(_count), "u long, n long"))
    return written(first.unionAll(counted).groupBy("u").agg(F.sum("n").alias("n_partners")), "ngram-partners")


def open_blocks(placed: DataFrame) -> DataFrame:
    """The rows ``sig, cls, comp`` of the blocks that stand in several components."""
    several = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    out = written(placed.join(several, "sig"), "ngram-open-blocks")
    discard(placed)
    return out


def _sizes_allow(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _most_differences(n: Column, m: Column) -> Column:
    """The largest symmetric difference with which sets of these sizes link."""
    return F.floor((n + m) * (100 - PERCENT) / (100 + PERCENT))


def _hamming(a: Column, b: Column) -> Column:
    """Differing bits of two sketches."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
                for k in range(SKETCH_BITS // 64)), F.lit(0))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_copies, representative, tkey.

    ``representative`` marks the document that a component is named after
    (its repeated rows too); ``tkey`` is the hash of the text.

    With ``count_links`` also n_links, the other documents that link with the
    document, its copies included; it takes the comparison of all sets inside a component.
    """
    spark = docs.sparkSession
    own_id = F.col(id_col).cast("long")
    src = docs.select(own_id.alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"),
                      F.col(text_col).alias("t"), F.coalesce(own_id, F.lit(-(1 << 63))).alias("k"))
    rows = written(src.mapInArrow(lean(_classify), _ROWS), "ngram-docs")
    is_doc = F.col("hot").isNull()
    often = (rows.where(~is_doc).groupBy("hot").agg(F.sum("n_hot").alias("n"))
             .orderBy(F.desc("n"), "hot").limit(HOT_SHINGLES).toPandas())
    hot = spark.sparkContext.broadcast(np.sort(often["hot"].to_numpy(np.int64).view(np.uint64)))
    classes = written(
        rows.where(is_doc & F.col("cls").isNotNull()).groupBy("cls").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("rep"),
            F.count("*").alias("n_copies")), "ngram-classes")

    sigs = src.select("t").mapInArrow(lean(_emit(hot)), "sig long, cls long, hub long")
    # A set that its own chunk has given a hub may be dealt anywhere.
    member = F.col("hub").isNotNull() & (F.col("hub") != F.col("cls"))
    dealt = F.when(member, F.xxhash64("sig", "cls")).otherwise(F.col("sig"))
    met = written(sigs.repartition(dealt).sortWithinPartitions("sig")
                  .mapInArrow(lean(_meet), "sig long, cls long, hub long"), "ngram-blocks")

    # One block for all that the same sets share; a set with copies in several chunks has a row for each.
    groups = met.select("sig", "cls").distinct().groupBy("sig").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")).where("n > 1")
    kept = groups.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    blocks_met, met = met, written(met.join(kept, "sig"), "ngram-shared")
    discard(blocks_met)

    used = met.select("cls").distinct().join(classes, "cls").select(
        "cls", F.coalesce("rep.doc_id", F.lit(-(1 << 63))).alias("k"), "rep.tkey")
    one_row = F.row_number().over(Window.partitionBy("k", "tkey").orderBy("k"))
    texts = src.select("k", "tkey", "t").join(used, ["k", "tkey"]).withColumn("nth", one_row).where("nth = 1")
    texts = written(texts.select("cls", "t").mapInArrow(
        lean(_measure), "cls long, t string, n long, sketch array<long>, long_sketch array<long>"), "ngram-texts")
    info = texts.select("cls", "n", "sketch")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs ``u, v`` that sizes and sketches allow to link."""
        of_u = info.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("s_u"))
        of_v = info.select(F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("s_v"))
        return (pairs.join(of_v, "v").join(of_u, "u")
                .where(_sizes_allow(F.col("n_u"), F.col("n_v"))
                       & (_hamming(F.col("s_u"), F.col("s_v")) <= _most_differences(F.col("n_u"), F.col("n_v"))))
                .select("u", "v"))

    def star(pairs: DataFrame) -> DataFrame:
        """Of the pairs ``u, v`` that share blocks, for each ``v`` the ``u`` with which it shares most."""
        return pairs.groupBy("u", "v").agg(F.count("*").alias("n")).groupBy("v").agg(
            F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")

    # Every set against one hub; what these links join needs no further check.
    to_hub = written(star(met.where("cls <> hub").select(F.col("hub").alias("u"), F.col("cls").alias("v"))), "ngram-hubs")
    links = _linked(allowed(to_hub), texts, "ngram-hub")
    label = components(links)

    # What shares a block across components; once more hubs for each, now those that stand in most open blocks.
    placed = (met.select("sig", "cls").distinct().join(label, F.col("cls") == F.col("node"), "left")
              .select("sig", "cls", F.coalesce("label", "cls").alias("comp")))
    placed = open_blocks(written(placed, "ngram-placed"))
    discard(met)
    tested = to_hub
    for _ in range(HUB_ROUNDS):
        degree = placed.groupBy("cls").agg(F.count("*").alias("degree"))
        ranked = placed.join(degree, "cls")
        leads = ranked.groupBy("sig").agg(F.max_by(F.struct("cls", "comp"), F.struct("degree", "cls")).alias("lead"))
        pairs = (placed.join(leads, "sig").where(F.col("comp") != F.col("lead.comp"))
                 .select(F.col("lead.cls").alias("u"), F.col("cls").alias("v")))
        to_hub = written(star(pairs.join(tested, ["u", "v"], "left_anti")), "ngram-hubs")
        tested = tested.unionAll(to_hub)
        more = _linked(allowed(to_hub), texts, "ngram-more")
        if more.isEmpty():
            break
        joined = components(relabel(more, label), "labels-more")
        label = written(compose(label, joined), "labels")
        links = links.unionAll(more)
        placed_before = placed
        placed = open_blocks(written(placed.join(joined, F.col("comp") == F.col("node"), "left").select(
            "sig", "cls", F.coalesce("label", "comp").alias("comp")), "ngram-placed"))
        discard(placed_before)

    # Pairs in what is still open: all but those inside the largest component of a block.
    per = placed.groupBy("sig", "comp").agg(F.count("*").alias("n")).groupBy("sig").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"))
    again = placed.join(per, "sig")
    open_rows = written(again.select("sig", "main", "cls", "comp").join(info, "cls"), "ngram-open")
    a = open_rows.where("comp <> main").select("sig", *[F.col(c).alias(f"a_{c}") for c in ("cls", "comp", "n", "sketch")])
    b = open_rows.select("sig", F.col("main"), *[F.col(c).alias(f"b_{c}") for c in ("cls", "comp", "n", "sketch")])
    once = (F.col("b_comp") == F.col("main")) | (F.col("a_cls") < F.col("b_cls"))
    cross = (a.join(b, (a["sig"] == b["sig"]) & (F.col("a_comp") != F.col("b_comp")) & once
                    & _sizes_allow(F.col("a_n"), F.col("b_n"))
                    & (_hamming(F.col("a_sketch"), F.col("b_sketch")) <= _most_differences(F.col("a_n"), F.col("b_n"))))
             .select(F.least("a_cls", "b_cls").alias("u"), F.greatest("a_cls", "b_cls").alias("v")).distinct())
    last = _linked(cross, texts, "ngram-cross")
    label = written(compose(label, components(relabel(last, label), "labels-last")), "labels")
    links = links.unionAll(last)

    named = (classes.join(label, F.col("cls") == F.col("node"), "left")
             .select("cls", "rep", "n_copies", F.coalesce("label", "cls").alias("label")))
    named = written(named, "ngram-named")
    comp = named.groupBy("label").agg(F.min("rep").alias("first"))
    final = named.join(comp, "label").select(F.col("cls").alias("c"), "first", "n_copies")
    if count_links:
        partners = _partners(links, label, classes, texts)
        final = final.join(partners, F.col("c") == F.col("u"), "left").select(
            "c", "first", "n_copies", (F.col("n_copies") - 1 + F.coalesce("n_partners", F.lit(0))).alias("n_links"))
    out = rows.where(is_doc).select("doc_id", "n", "cls", "tkey").join(final, F.col("cls") == F.col("c"), "left")
    alone = F.col("cls").isNull()
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        *([F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")] if count_links else []),
        (alone | leads).alias("representative"), "tkey")
