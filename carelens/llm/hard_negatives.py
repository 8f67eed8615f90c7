"""Hard-negative mining by lists that clustered anchors share.

For each anchor, its positives are the rows of its label with the highest inner
product; for each positive, the hard negatives are the rows of other labels with
the highest product between ``floor_percent`` per cent of the positive's and the
positive's own. Ties go to the smaller id. Vectors are scaled and rounded down to
integers, so that products are exact.

**Clusters.** Anchors are assigned to centroids (spherical k-means on a bounded
sample of anchors); a cluster of more than ``CLUSTER_ANCHORS`` is cut by the hash
of the id, so no group grows with a hot vector.

**Shared lists.** For a member ``u`` at an angle of at most ``t`` from its
centroid, a row ``i`` at angle ``a`` has ``u . i <= |u| |i| cos(max(0, a - t))``. A
task sorts the rows of its batch once per cluster by this bound, and every member
walks that list in steps until the bound of what is left is below what it
still needs: the k-th product found so far, or the floor that its positives set. That
stop is certified, the result is exact. What a member needs is kept from batch to batch.

**Blocks.** Anchors are a stated query set, taken in blocks of at most about ``BLOCK_ANCHORS``:
one pass over all rows finds their positives, another their negatives. A block and
its positives are all that is sent to the tasks, and all that the driver holds. A task
returns its k best per anchor; these are merged per anchor.

Edge cases: rows with a NULL id, label or vector, or with a NULL or non-finite
component take no part; rows that repeat an id are one row, the least of them (label,
then vector); shorter vectors are filled with zeros; scaled components beyond
+-``LIMIT`` are held there (sums stay exact up to 512 dimensions); an anchor without another row of
its label, a positive without a row in its band, and a positive of a negative product give no
rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.llm.common import importable, lean, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
FLOOR_PERCENT = 80
LIMIT = 1 << 22
SAMPLE_ANCHORS = 2048
MAX_CLUSTERS = 64
CLUSTER_ANCHORS = 512
BLOCK_ANCHORS = 4096
FIRST_STEP, LAST_STEP = 128, 2048
ANGLE_SLACK = 1e-6


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
            scale: int = SCALE) -> DataFrame:
    """``id, label, v``: the rows that take part, one per id, components scaled to integers."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    scaled = F.transform("v", lambda x: F.greatest(F.least(F.floor(scale * x), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return (src.select("id", F.struct("label", scaled.alias("v")).alias("r")).groupBy("id")
            .agg(F.min("r").alias("r")).select("id", "r.label", "r.v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles, filled with zeros or cut to ``dims``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(column.offsets.to_numpy())
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    inside = place < dims
    out[row[inside], place[inside]] = flat[inside]
    return out


# --------------------------------------------------------------- clusters

def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def centroids(sample: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit centroids of a sample, about the root of its number of rows."""
    unit = _unit(sample)
    k = min(MAX_CLUSTERS, max(1, int(np.ceil(np.sqrt(len(unit))))))
    centre = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, unit)
        centre = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _unit(total), centre)
    return centre


class Block:
    """Anchors of some clusters, ordered by cluster: what a pass sends to its tasks."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, clusters: np.ndarray, centre: np.ndarray):
        order = np.lexsort((ids, clusters))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.norm = np.linalg.norm(self.vectors, axis=1)
        clusters = clusters[order]
        first = np.flatnonzero(np.concatenate([[True], clusters[1:] != clusters[:-1]]))
        self.clusters = []
        for a, b in zip(first.tolist(), [*first.tolist()[1:], len(order)], strict=True):
            c = centre[clusters[a]]
            cosine = np.clip(_unit(self.vectors[a:b]) @ c, -1, 1)
            self.clusters.append((a, b, c, float(np.arccos(cosine).max())))

    @property
    def dims(self) -> int:
        return self.vectors.shape[1]


def shared_list(rows: np.ndarray, norm: np.ndarray, centre: np.ndarray, widest: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows in falling order of the bound that holds for every member of a cluster; and the bounds."""
    cosine = np.divide(rows @ centre, norm, out=np.ones(len(rows)), where=norm > 0)
    angle = np.arccos(np.clip(cosine, -1, 1))
    bound = norm * np.cos(np.maximum(0, angle - widest - ANGLE_SLACK))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Best:
    """The k best rows of each query so far: highest product, then least id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def kth(self, q: int) -> float:
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[keep], ids[keep]
        self.rows[q] = sorted(self.rows[q] + list(zip((-scores).tolist(), ids.tolist(), strict=True)))[:self.k]


def walk(block: Block, rows: np.ndarray, need: np.ndarray, take: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Give each anchor the rows that could matter to it; the number of products computed.

    ``need`` is each anchor's least useful product; ``take`` may raise it.
    """
    norm = np.linalg.norm(rows, axis=1)
    largest = norm.max(initial=0.0)
    done = 0
    for a, b, centre, widest in block.clusters:
        order, bound = shared_list(rows, norm, centre, widest)
        at, step = 0, FIRST_STEP
        while at < len(order):
            most = block.norm[a:b] * (bound[at] + 1e-9 * largest) + 1e-3
            members = a + np.flatnonzero(most >= need[a:b])
            if not len(members):
                break  # certified: bounds only fall from here
            part = order[at:at + step]
            product = block.vectors[members] @ rows[part].T
            done += product.size
            for m, p in zip(members.tolist(), product, strict=True):
                useful = np.flatnonzero(p >= need[m])
                if len(useful):
                    take(m, p[useful], part[useful])
            at, step = at + step, min(2 * step, LAST_STEP)
    return done


# ----------------------------------------------------------------- passes

def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best, need = Best(len(block.ids), k), np.full(len(block.ids), -np.inf)
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))

            def take(m, scores, part, ids=ids, labels=labels):
                fit = (labels[part] == block.labels[m]) & (ids[part] != block.ids[m])
                if fit.any():
                    best.add(m, scores[fit], ids[part[fit]])
                    need[m] = best.kth(m)

            walk(block, matrix(batch.column(2), block.dims), need, take)
        found = [(m, i, int(-s)) for m, rows in enumerate(best.rows) for s, i in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.ids[m] for m, _, _ in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
             pa.array([x[2] for x in found], pa.int64())], names=["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(shared, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of, positive, top = shared.value  # the queries: anchor's place, positive's id and product
        least = -(-top * percent // 100)
        queries = [np.flatnonzero(of == m) for m in range(len(block.ids))]
        best = Best(len(of), k)
        need_of = np.where(top >= 0, least, np.inf).astype(float)  # no product is in a negative band
        need = np.array([need_of[q].min(initial=np.inf) for q in queries])
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))

            def take(m, scores, part, ids=ids, labels=labels):
                other = labels[part] != block.labels[m]
                scores, part = scores[other], part[other]
                for q in queries[m].tolist():
                    fit = (scores <= top[q]) & (scores >= need_of[q])
                    if fit.any():
                        best.add(q, scores[fit], ids[part[fit]])
                        need_of[q] = max(need_of[q], best.kth(q))
                need[m] = need_of[queries[m]].min()

            walk(block, matrix(batch.column(2), block.dims), need, take)
        found = [(q, i, int(-s)) for q, rows in enumerate(best.rows) for s, i in rows]
        at = np.array([q for q, _, _ in found], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids[of[at]]), pa.array(positive[at]), pa.array(top[at]),
             pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
            names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def _blocks(anchors: DataFrame) -> Iterator[Block]:
    """The anchors, block by block; the driver holds one block."""
    spark = anchors.sparkSession
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ANCHORS).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return
    dims = int(np.diff(sample.offsets.to_numpy()).max())
    centre = centroids(matrix(sample, max(dims, 1)))
    shared = spark.sparkContext.broadcast(centre)  # at most MAX_CLUSTERS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argmax(matrix(batch.column(2), shared.value.shape[1]) @ shared.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))],
                                             names=[*batch.schema.names, "cluster"])

    placed = written(anchors.mapInArrow(lean(assign), "id long, label long, v array<int>, cluster int"), "negative-anchors")
    sizes = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    groups: list[list[tuple[int, int, int]]] = [[]]  # clusters, or hash parts of them, to a block
    room = BLOCK_ANCHORS
    for c in sorted(sizes):
        parts = -(-sizes[c] // CLUSTER_ANCHORS)
        for p in range(parts):
            size = -(-sizes[c] // parts)
            if room < size:
                groups.append([])
                room = BLOCK_ANCHORS
            groups[-1].append((c, parts, p))
            room -= size
    for group in groups:
        chosen = F.lit(False)
        for c, parts, p in group:
            chosen = chosen | ((F.col("cluster") == c) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == p))
        rows = placed.where(chosen).toArrow().combine_chunks()
        if rows.num_rows:
            v = rows.column("v").combine_chunks()
            wide = max(int(np.diff(v.offsets.to_numpy()).max()), centre.shape[1])
            padded = np.zeros((len(centre), wide))
            padded[:, :centre.shape[1]] = centre
            ids, labels, clusters = (rows.column(x).to_numpy() for x in ("id", "label", "cluster"))
            yield Block(ids, labels, matrix(v, wide), clusters, padded)


def _first(df: DataFrame, k: int, by: list[str], score: str, id_col: str, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id_col))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         floor_percent: int = FLOOR_PERCENT, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the prepared rows' ``id`` and ``label``.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = written(prepare(vectors, id_col, vector_col, label_col, scale), "negative-rows")
    found = []
    for block in _blocks(rows.where(is_anchor)):
        shared = spark.sparkContext.broadcast(block)
        near = rows.mapInArrow(lean(_positives(shared, positives)), "anchor_id long, positive_id long, positive_score long")
        # At most ``positives`` rows for each anchor of the block.
        top = _first(near, positives, ["anchor_id"], "positive_score", "positive_id").toArrow().combine_chunks()
        ids = top.column("anchor_id").to_numpy()
        of = np.searchsorted(np.sort(block.ids), ids)
        of = np.argsort(block.ids, kind="stable")[of] if len(ids) else of
        queries = spark.sparkContext.broadcast(
            (block, of, top.column("positive_id").to_numpy(), top.column("positive_score").to_numpy()))
        far = rows.mapInArrow(
            lean(_negatives(queries, negatives, floor_percent)),
            "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        found.append(written(_first(far, negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id"),
                             "negatives"))
        shared.unpersist()
        queries.unpersist()
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, rank int"
    out = spark.createDataFrame([], schema)
    if found:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                      "positive_score", "negative_score")
