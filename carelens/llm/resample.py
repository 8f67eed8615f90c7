"""Target-distribution importance resampling over hashed n-grams.

A document's features are its runs of one to ``order`` consecutive words
(lower-cased A-Z; letters, digits and all that is not ASCII make words), each
hashed to a bucket by CRC-32. Buckets are counted over all documents and over
the target table; a bucket's gain is the log ratio of its two smoothed
frequencies, a document's weight the mean gain of its features. Adding a keyed
Gumbel number to each weight and taking the highest scores draws without
replacement, in proportion to exp(weight / 1000).

**CRCs.** A chunk's words and runs are numbered, so each distinct feature is
hashed once. Distinct features are grouped by length: those of one length are
the rows of a two-dimensional uint8 matrix, whose CRCs advance together, one
column at a time, and are scattered back to the places of their features. (A
feature above ``LONG_BYTES`` has no others beside it to advance with and is
given to zlib, which computes the same number.)

**Bounds.** A task holds one chunk of about ``CHUNK_WORDS`` words (or one
text) and an array of ``buckets`` counts, which it emits once; the driver holds
the gains (``buckets`` numbers) and a histogram of score ranges. Only drawn
ranges are sorted, in range partitions; a row's rank is its place in its
partition after the sizes of those before. No text is shuffled.

Edge cases: NULL, empty and blank texts and texts of other characters have
no features, weight 0, and are never drawn (``min_words``); a NULL id hashes
as ``null``; repeated rows are separate documents (they share a score, and their
order among each other is that of reading); ties go to the smaller id, NULL last;
an empty table gives no rows, an empty target leaves every gain to the smoothing; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import importable, lean, written

BUCKETS = 10_000
ORDER = 2
SHARE = 25  # per cent of the documents that are long enough
MIN_WORDS = 20
SEED = 7
CHUNK_WORDS = 1 << 19
MATRIX_BYTES = 1 << 22
LONG_BYTES = 4096
SCORE_BIN = 100
ROWS_PER_RANGE = 1 << 20

#: Word bytes, A-Z lowered; every other byte becomes a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC_TABLE = _crc_table()


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a uint8 matrix, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in matrix.T:
        crc = CRC_TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature; features of one length are one matrix (cut at MATRIX_BYTES)."""
    out = np.zeros(len(features), np.uint32)
    length = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(length, kind="stable")
    lengths, size = np.unique(length, return_counts=True)
    for n, a, k in zip(lengths.tolist(), (np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
        rows = order[a:a + k]
        if n > LONG_BYTES:
            out[rows] = [zlib.crc32(features[k]) for k in rows.tolist()]
            continue
        step = max(1, MATRIX_BYTES // max(n, 1))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            flat = np.frombuffer(b"".join([features[k] for k in part.tolist()]), np.uint8)
            out[part] = crc_columns(flat.reshape(len(part), n))
    return out


class Chunk:
    """The feature buckets of some texts: one array per run length, with the texts' bounds in it."""

    def __init__(self, texts: list[list[bytes]], buckets: int, order: int):
        self.n_words = np.array([len(t) for t in texts], np.int64)
        vocabulary: dict[bytes, int] = {}
        number = vocabulary.setdefault
        ids = np.array([number(w, len(vocabulary)) for t in texts for w in t], np.int64)
        vocab = list(vocabulary)
        base = (crcs(vocab) % np.uint32(buckets)).astype(np.int64)
        self.runs = [(base[ids], self.n_words)]
        of = np.repeat(np.arange(len(texts)), self.n_words)
        shorter, now = vocab, ids
        for k in range(2, order + 1):
            n = np.maximum(self.n_words - (k - 1), 0)
            inside = of[:len(of) - (k - 1)] == of[k - 1:] if len(of) >= k else np.zeros(0, bool)
            key = (now[:len(inside)] * max(len(vocab), 1) + ids[k - 1:])[inside] if len(inside) else np.zeros(0, np.int64)
            distinct, at = np.unique(key, return_inverse=True)
            longer = [shorter[a] + b" " + vocab[b] for a, b in
                      zip((distinct // max(len(vocab), 1)).tolist(), (distinct % max(len(vocab), 1)).tolist(), strict=True)]
            bucket = (crcs(longer) % np.uint32(buckets)).astype(np.int64)
            self.runs.append((bucket[at], n))
            if k < order:  # numbers of the runs by the place of their first word
                place = np.zeros(len(inside), np.int64)
                place[inside] = at
                now, shorter = place, longer

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(b, minlength=buckets) for b, _ in self.runs)

    def sums(self, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and summed gains of each text."""
        n_features = sum(n for _, n in self.runs)
        total = np.zeros(len(self.n_words), np.int64)
        for bucket, n in self.runs:
            upto = np.concatenate([[0], np.cumsum(gain[bucket])])
            end = np.cumsum(n)
            total += upto[end] - upto[end - n]
        return n_features, total


def chunks(column: pa.Array, buckets: int, order: int) -> Iterator[tuple[int, Chunk]]:
    """Chunks of a batch's texts, each with the row where it starts."""
    held, size, first = [], 0, 0
    for k, x in enumerate(column):
        ws = words(x.as_py())
        held.append(ws)
        size += len(ws)
        if size >= CHUNK_WORDS:
            yield first, Chunk(held, buckets, order)
            held, size, first = [], 0, k + 1
    if held:
        yield first, Chunk(held, buckets, order)


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """``bucket, n`` over all texts of a table; a task adds up its own first."""
    importable(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, chunk in chunks(batch.column(0), buckets, order):
                total += chunk.counts(buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return (table.select(F.col(text_col).alias("t")).mapInArrow(lean(run), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text",
          buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """The gain of every bucket; at most ``buckets`` rows come to the driver."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    own = bucket_counts(docs, text_col, buckets, order).withColumnRenamed("n", "s")
    of_target = bucket_counts(target, target_text_col, buckets, order).withColumnRenamed("n", "t")
    both = written(every.join(own, "bucket", "left").join(of_target, "bucket", "left")
                   .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    rows = both.collect()
    all_s, all_t = float(sum(r["s"] for r in rows)), float(sum(r["t"] for r in rows))
    gain = np.zeros(buckets, np.int64)
    for r in rows:
        ratio = ((r["t"] + 1.0) * (all_s + buckets)) / ((r["s"] + 1.0) * (all_t + buckets))
        gain[r["bucket"]] = math.floor(1000 * math.log(ratio))
    return gain


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER) -> DataFrame:
    """``doc_id, row, n_words, n_features, weight`` of every document; ``row`` tells repeated rows apart."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(gain)  # ``buckets`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, n = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, chunk in chunks(batch.column(1), len(gain), order):
                size = len(chunk.n_words)
                n_features, total = chunk.sums(gain)
                weight = total // np.maximum(n_features, 1)  # floors go down
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size), pa.array(np.arange(n, n + size)), pa.array(chunk.n_words),
                     pa.array(n_features), pa.array(weight)],
                    names=["doc_id", "row", "n_words", "n_features", "weight"])
                n += size

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        lean(run), "doc_id long, row long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number per id and seed, in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _rank(rows: DataFrame, parts: int, n_drawn: int) -> DataFrame:
    """``rank`` of rows by score, ties by id; NULL beyond ``n_drawn``."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    sorted_rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(np.arange(n + 1, n + size + 1))],
                names=[*batch.schema.names, "part", "place"])
            n += size

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", part int, place long"
    placed = written(sorted_rows.mapInArrow(lean(run), schema), "resample-order")
    # One row per range partition, whose number is set above.
    size = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.max("place").alias("n")).collect()}
    before, ahead = 0, []
    for p in sorted(size):
        ahead.append((p, before))
        before += size[p]
    offsets = rows.sparkSession.createDataFrame(ahead, "part int, before long")
    rank = F.col("before") + F.col("place")
    return placed.join(F.broadcast(offsets), "part").select(
        *rows.columns, F.when(rank <= n_drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (NULL if not drawn).

    Drawn are floor(share * N / 100) of the N documents with ``min_words`` words.
    """
    gain = gains(docs, target, text_col, target_text_col, buckets, order)
    weighed = weigh(docs, gain, id_col, text_col, order)
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")

    able = F.col("n_words") >= min_words
    # Scores lie within the logarithms of 64-bit counts: a few hundred ranges.
    bins = {r["bin"]: r["n"] for r in scored.where(able).groupBy(F.floor(F.col("score") / SCORE_BIN).alias("bin"))
            .agg(F.count("*").alias("n")).collect()}
    n_drawn = share * sum(bins.values()) // 100
    rest, lowest = n_drawn, None
    for b in sorted(bins, reverse=True):
        if rest <= 0:
            break
        rest, lowest = rest - bins[b], b
    if lowest is None:
        out = scored.withColumn("rank", F.lit(None).cast("long"))
    else:
        near = able & (F.col("score") >= lowest * SCORE_BIN)
        n_near = sum(n for b, n in bins.items() if b >= lowest)
        shuffles = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(min(shuffles, n_near // 4096 + 1), -(-n_near // ROWS_PER_RANGE))
        out = _rank(scored.where(near), parts, n_drawn).unionByName(
            scored.where(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
