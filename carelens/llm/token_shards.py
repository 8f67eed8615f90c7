"""Token-ID output in training order.

1. **Tokenise** every whole text once with a public byte-level BPE, an end
   token after each document, and store the ids with their offset inside the
   partition that wrote them (one table in the shared folder).
2. **Number**: partition totals, scanned, give every token a place in one
   stream; sequence ``j`` is tokens ``[j * L, (j + 1) * L)``. Documents are
   cut at sequence ends; the last sequence is padded.
3. **Permute**: a keyed Feistel network over the smallest even power of two
   that covers the number of sequences, cycle-walked until it lands inside,
   gives each sequence its slot in training order. It is a bijection that any
   reader can evaluate and invert from the key alone.
4. **Write**: pieces go to the range partition of their slot; each partition
   emits its shards, ``slots_per_shard`` records of exactly ``stride`` bytes,
   so slot ``s`` is at byte ``(s % slots_per_shard) * stride`` of shard
   ``s // slots_per_shard`` and a run is resumed by skipping to a slot.

A shard is one Parquet row (number, first slot, payload), so shards can be
in any store that Spark reads; a task holds one shard at a time.

Edge cases: NULL and empty texts are an end token alone; an empty table
gives no shards; a lone surrogate is written as the replacement character;
repeated rows are separate documents; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.llm.common import lean, written

SEQ_LEN = 1024
SLOTS_PER_SHARD = 512
KEY = "order-1"
ROUNDS = 6
DTYPE = np.dtype("<u2")
CACHE_CHUNKS = 600_000  # of at most 32 characters: about 100 MB
RANGE_BYTES = 64 << 20

# Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file, and its first free id as the end token."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


class Chunks(dict):
    """Ids, as bytes, of a blank and the non-blank start that follows it.

    The split pattern never joins characters across the place before such a
    blank when a non-blank stands there too, so the chunks of a text can be
    encoded apart and remembered.
    """

    def __init__(self, path: str):
        super().__init__()
        encoder, end = encoding(path)
        self.encode, self.end = encoder.encode_ordinary, np.array([end], DTYPE).tobytes()

    def ids(self, text: str) -> bytes:
        got = self.encode(text)
        return struct.pack(f"<{len(got)}H", *got)

    def __missing__(self, chunk: str) -> bytes:
        out = self.ids(" " + chunk)
        if len(chunk) <= 32:
            self[chunk] = out
        return out

    def tokens(self, text: str | None) -> bytes:
        """Little-endian ids of a whole text, the end token last."""
        if not text:
            return self.end
        if len(self) > CACHE_CHUNKS:
            self.clear()
        parts = text.split(" ")
        if text[0] == " " or _MIXED.search(text):  # a blank beside other white space starts no chunk
            joined, parts = parts, []
            for p in joined:
                if parts and (not p or p[0].isspace() or parts[-1][-1:].isspace() or not parts[-1]):
                    parts[-1] += " " + p
                else:
                    parts.append(p)
        return b"".join([self.ids(parts[0]), *map(self.__getitem__, parts[1:]), self.end])


# Begins with the blank, so the search jumps from blank to blank.
_MIXED = re.compile(r" (?:\s|$|(?<=\s ))")


# ------------------------------------------------------------- permutation

class Permutation:
    """Keyed bijection of ``range(n)``: balanced Feistel with cycle-walking."""

    def __init__(self, n: int, key: str = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        digest = hashlib.shake_256(key.encode()).digest(8 * rounds)
        self.keys = [np.uint64(int.from_bytes(digest[8 * r:8 * r + 8], "little")) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ self._mix(left, k), left
            else:
                left, right = right, left ^ self._mix(right, k)
        return (left << h) | right

    def _walk(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x).astype(np.uint64), keys, back)
            while (outside := out >= np.uint64(self.n)).any():
                out[outside] = self._once(out[outside], keys, back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


# ------------------------------------------------------------------ steps

def tokenise(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, at, n_tokens, ids``: ids as bytes, ``at`` counted inside ``part``.

    Stored in the shared folder: numbers derived from it later do not
    change when a task is run again.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        chunks = Chunks(ranks_path)  # a task's own memory: it ends with the task
        for batch in batches:
            blobs = [chunks.tokens(_clean(x.as_py())) for x in batch.column(1)]
            n = np.array([len(b) // DTYPE.itemsize for b in blobs], np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(blobs), pa.int32()), pa.array(first), pa.array(n),
                 pa.array(blobs, pa.binary())], names=["doc_id", "part", "at", "n_tokens", "ids"])

    return written(src.mapInArrow(lean(run), "doc_id long, part int, at long, n_tokens long, ids binary"), "tokens")


def _clean(text: str | None) -> str | None:
    return text.encode("utf-8", "replace").decode() if text and not text.isascii() else text


def number(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, start, n_tokens, ids`` with the place in the stream; and the stream's length."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("base", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))).select("part", "base")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    placed = tokens.join(F.broadcast(base), "part")  # one row per writing task
    placed = placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
    return placed, int(total)


def pieces(placed: DataFrame, n_sequences: int, seq_len: int, key: str) -> DataFrame:
    """``slot, at, doc_id, ids``: documents cut at sequence ends."""
    perm = Permutation(n_sequences, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = DTYPE.itemsize
        for batch in batches:
            start, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            if not len(start):
                continue
            first, last = start // seq_len, (start + n - 1) // seq_len
            count = last - first + 1
            row = np.repeat(np.arange(len(start)), count)
            seq = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            a = np.maximum(seq * seq_len, start[row])
            b = np.minimum((seq + 1) * seq_len, (start + n)[row])
            slot = perm.slot(seq)
            lo, hi = (a - start[row]) * width, (b - start[row]) * width
            blobs, of = {}, row.tolist()
            cut = []
            for r, x, y in zip(of, lo.tolist(), hi.tolist(), strict=True):
                if r not in blobs:
                    blobs = {r: batch.column(3)[r].as_py()}
                cut.append(blobs[r][x:y])
            for i in range(0, len(cut), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[s]), pa.array((a - seq * seq_len)[s].astype(np.int32)),
                     batch.column(0).take(pa.array(row[s])), pa.array(cut[s], pa.binary())],
                    names=["slot", "at", "doc_id", "ids"])

    return placed.mapInArrow(lean(run), "slot long, at int, doc_id long, ids binary")


def assemble(cut: DataFrame, n_sequences: int, seq_len: int, slots_per_shard: int, pad: int) -> DataFrame:
    """Shards from pieces: one row per shard, slots in order, fixed stride.

    The partition of a slot is known beforehand (slots are uniform), so
    pieces are dealt to ranges without sampling; a task sorts its range and
    streams it, holding one shard.
    """
    shards = -(-n_sequences // slots_per_shard)
    spark = cut.sparkSession
    # A task sorts about RANGE_BYTES, whatever the size of the input.
    per_part = max(1, RANGE_BYTES // (slots_per_shard * seq_len * DTYPE.itemsize))
    per_part = min(per_part, -(-shards // max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    parts = -(-shards // per_part)
    shard = F.floor(F.col("slot") / slots_per_shard)
    dealt = cut.repartitionById(parts, F.floor(shard / per_part).cast("int")).sortWithinPartitions("slot", "at")
    stride = seq_len * DTYPE.itemsize
    blank = np.full(seq_len, pad, DTYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buf, ids, filled = None, bytearray(), [], 0

        def done():
            size = min(slots_per_shard, n_sequences - now * slots_per_shard)
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([now * slots_per_shard]), pa.array([size]), pa.array([stride], pa.int32()),
                 pa.array([filled]), pa.array([ids], pa.list_(pa.list_(pa.int64()))),
                 pa.array([bytes(buf)], pa.binary())],
                names=["shard", "first_slot", "n_slots", "stride", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            for s, at, d, x in zip(*(batch.column(k) for k in range(4)), strict=True):
                s, blob = s.as_py(), x.as_py()
                if s // slots_per_shard != now:
                    if now is not None:
                        yield done()
                    now = s // slots_per_shard
                    size = min(slots_per_shard, n_sequences - now * slots_per_shard)
                    buf, ids, filled = bytearray(blank * size), [[] for _ in range(size)], 0
                k = s % slots_per_shard
                o = k * stride + at.as_py() * DTYPE.itemsize
                buf[o:o + len(blob)] = blob
                filled += len(blob) // DTYPE.itemsize
                ids[k].append(d.as_py())
        if now is not None:
            yield done()

    return dealt.mapInArrow(
        lean(run), "shard long, first_slot long, n_slots long, stride int, n_tokens long, "
             "doc_ids array<array<long>>, payload binary")


def shards(
    docs: DataFrame,
    ranks_path: str,
    seq_len: int = SEQ_LEN,
    slots_per_shard: int = SLOTS_PER_SHARD,
    key: str = KEY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The shards of ``docs`` in training order (see the module's text)."""
    end = encoding(ranks_path)[1]
    placed, total = number(tokenise(docs, ranks_path, id_col, text_col))
    n = max(-(-total // seq_len), 1)
    return with_digest(assemble(pieces(placed, n, seq_len, key), n, seq_len, slots_per_shard, end))


def with_digest(table: DataFrame) -> DataFrame:
    """The SHA-256 of every payload beside it, for checking a copy."""
    return table.select("shard", "first_slot", "n_slots", "stride", "n_tokens", F.flatten("doc_ids").alias("doc_ids"),
                        F.sha2("payload", 256).alias("payload_sha256"), "payload")


def write_shards(docs: DataFrame, path: str, ranks_path: str, **options) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` as Parquet, one row a shard."""
    table = shards(docs, ranks_path, **options)
    table.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(table.schema).parquet(path)


def read_from(shards: DataFrame, slot: int) -> DataFrame:
    """Records from ``slot`` on, in order: ``slot, ids`` (bytes of one stride).

    Shards before the slot are skipped by their number.
    """
    rows = shards.where(F.col("first_slot") + F.col("n_slots") > slot)

    def record(k):
        at = (k * F.col("stride") + 1).cast("int")
        return F.struct((F.col("first_slot") + k).alias("slot"),
                        F.substring(F.col("payload"), at, F.col("stride")).alias("ids"))

    records = F.transform(F.sequence(F.lit(0), F.col("n_slots").cast("int") - 1), record)
    return rows.select(F.inline(records)).where(F.col("slot") >= slot).orderBy("slot")

