"""Blocked top-k similarity retrieval.

Queries and history are unit TF-IDF rows; a query searches the history of its intent,
or all of it when that intent has none. Top k by cosine, ties to the larger document
id, similarities rounded to 6 places; documents that share no term fill up with
similarity 0.

The search is exact. Queries and documents of a block are packed, a row each, and dealt by
the hash of their id to parts of about ``CELL_QUERIES`` and ``CELL_DOCS`` rows (fewer where
they hold more than ``CELL_TERMS`` terms). A cell is a part of the queries with a part of
the documents; a task scores it in memory (:mod:`carelens.operators.scoring`) and hands on
the cell's best k per query. So the work grows with queries times history, but what is
shuffled are the packed rows once per cell, and what a task holds is bounded.

Queries are independent of each other: they are searched in slices, by the hash of
their id, one after the other, and only a slice's best k are kept. The number of slices
is the number of (query, document) pairs that a join of the terms would make, counted
exactly before, over ``PAIRS`` pairs per term of the index; so the packed rows on disk grow
with the index and not with its product with the queries.

One plan serves all sizes: no size checks, no broadcast hints; AQE picks the
join strategies from measured sizes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.operators import scoring, vectors
from carelens.session import delete_path, importable, materialize, write_once

ALL_BLOCK = "__all__"
CELL_QUERIES, CELL_DOCS = 1 << 12, 1 << 13
CELL_TERMS = 1 << 21  # of either side
PAIRS = 1 << 12  # a slice of queries makes, per term of the index


def assign_blocks(queries: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``block``: the query intent when history has that intent,
    else ``__all__`` (search all history)."""
    hist_intents = history.select(F.col("intent").alias("q_intent")).distinct() \
        .withColumn("has_history", F.lit(True))
    return (queries.join(hist_intents, queries.intent.eqNullSafe(hist_intents.q_intent), "left")
            .withColumn("block", F.when(F.col("has_history"), F.col("intent"))
                        .otherwise(F.lit(ALL_BLOCK)))
            .drop("q_intent", "has_history"))


@dataclass
class Index:
    """Document terms, the same packed, and the sizes of the blocks."""
    terms: DataFrame  # doc_id, intent, term, wd
    docs: DataFrame   # doc_id, intent, terms, weights
    sizes: DataFrame  # block, docs, doc_terms


def _packed(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """A row per key with its ``terms`` and ``weights``."""
    v = F.collect_list(F.struct("term", F.col(weight).alias("w"))).alias("v")
    return rows.groupBy(*keys).agg(v).select(*keys, F.col("v.term").alias("terms"), F.col("v.w").alias("weights"))


def _in_blocks(docs: DataFrame) -> DataFrame:
    """Each document in the block of its intent and in that of all history."""
    return docs.withColumn("block", F.explode(F.array("intent", F.lit(ALL_BLOCK)))).drop("intent")


def build_index(terms: DataFrame) -> Index:
    docs = materialize(_packed(terms, ["doc_id", "intent"], "wd"))
    sizes = _in_blocks(docs).groupBy("block").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("terms")).alias("doc_terms"))
    return Index(terms, docs, materialize(sizes))


def _meet(qt: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Query terms with the rows of a document side in the block that the query searches."""
    own = qt.where(F.col("block") != ALL_BLOCK).withColumnRenamed("block", "intent").join(side, [*keys, "intent"])
    every = qt.where(F.col("block") == ALL_BLOCK).drop("block").join(side, keys)
    return own.drop("intent").unionByName(every.drop("intent"))


def _parts(rows: str, terms: str, size: int) -> Column:
    return F.ceil(F.greatest(F.col(rows) / size, F.col(terms) / CELL_TERMS))


def cells(asked: DataFrame, index: Index) -> DataFrame:
    """``block, q_parts, d_parts`` of packed queries."""
    per = asked.groupBy("block").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.size("terms")).alias("query_terms"))
    return per.join(index.sizes, "block").select(
        "block", _parts("queries", "query_terms", CELL_QUERIES).alias("q_parts"), _parts("docs", "doc_terms", CELL_DOCS).alias("d_parts"))


def _dealt(rows: DataFrame, plan: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Packed rows, each in the cells that its part makes with every part of the other side."""
    # Not the hash that cuts the slices: it would leave parts empty.
    part = F.pmod(F.xxhash64(F.lit(own), key), f"{own}_parts").alias(f"{own}_part")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)).alias(f"{other}_part")
    return rows.join(plan, "block").select("block", part, every, key, "terms", "weights")


def candidates(qt: DataFrame, index: Index, k: int, made: list[str] | None = None) -> DataFrame:
    """``qid, doc_id, s``: the pairs that can be among the first k, with their scores.

    ``made`` receives the folders of the tables written for it.
    """
    made = [] if made is None else made
    asked = _written(_packed(qt, ["qid", "block"], "wq"), made)
    plan = _written(cells(asked, index), made)
    n = plan.agg(F.sum(F.col("q_parts") * F.col("d_parts"))).first()[0] or 0
    rows = _dealt(asked, plan, "qid", "q", "d").unionByName(
        _dealt(_in_blocks(index.docs), plan, "doc_id", "d", "q"), allowMissingColumns=True)
    key = ["block", "q_part", "d_part"]
    importable(qt.sparkSession)
    kinds = {**dict(index.docs.dtypes), **dict(asked.dtypes)}
    # Four partitions a cell: few cells meet in one task.
    return rows.repartition(4 * max(1, n), *key).groupBy(*key).applyInArrow(
        scoring.best_of_cell(k), f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, s double")


def search(qt: DataFrame, index: Index, k: int, made: list[str] | None = None) -> DataFrame:
    """``qid, doc_id, similarity`` of all pairs that can be among the first k."""
    return candidates(qt, index, k, made).select("qid", "doc_id", F.round("s", 6).alias("similarity"))


def _written(df: DataFrame, made: list[str]) -> DataFrame:
    table, path = write_once(df, "table")
    made.append(path)
    return table


def query_slices(qt: DataFrame, index: Index) -> int:
    """Slices of queries that keep the pairs of a slice at about ``PAIRS`` per term of the index."""
    asked = qt.groupBy("block", "term").agg(F.count(F.lit(1)).alias("nq"))
    held = index.terms.groupBy("intent", "term").agg(F.count(F.lit(1)).alias("nd"))
    met = _meet(asked, held, ["term"]).agg(F.sum(F.col("nq") * F.col("nd"))).first()[0] or 0
    return max(1, ceil(met / (PAIRS * max(1, index.terms.count()))))


def top_hits(qt: DataFrame, index: Index, k: int) -> DataFrame:
    """``qid, doc_id, similarity`` of the first k found, searched slice by slice; a slice's tables are deleted after it."""
    n = query_slices(qt, index)
    of = F.pmod(F.xxhash64("qid"), F.lit(n))
    parts = []
    for i in range(n):
        made: list[str] = []
        found = search(qt.where(of == i), index, k, made)
        parts.append(materialize(_top_k(found, k).select("qid", "doc_id", "similarity")))
        for path in made:
            delete_path(qt.sparkSession, path)
    return reduce(DataFrame.unionByName, parts)


def _top_k(df: DataFrame, k: int, part: str = "qid") -> DataFrame:
    w = Window.partitionBy(part).orderBy(F.desc("similarity"), F.desc("doc_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pad_table(history: DataFrame, k: int) -> DataFrame:
    """(block, doc_id) for the first k documents of every block (and of
    all history under ``__all__``) in tie order, similarity 0."""
    w = Window.partitionBy("intent").orderBy(F.desc("doc_id"))
    per_intent = (history.select("intent", "doc_id")
                  .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
                  .select(F.col("intent").alias("block"), "doc_id"))
    overall = (history.select("doc_id").orderBy(F.desc("doc_id")).limit(k)
               .select(F.lit(ALL_BLOCK).alias("block"), "doc_id"))
    return per_intent.unionByName(overall)


def postings(queries: DataFrame, history: DataFrame, min_df: int = 2, max_df: float = 0.95):
    """(q, qt, index): queries with blocks, their terms, the index of the history."""
    fitted = vectors.fit_tfidf(history, "doc_id", "text", min_df, max_df)
    vocab = materialize(fitted.vocab)
    delete_path(history.sparkSession, fitted.words_path)
    q = materialize(assign_blocks(queries, history))
    qt = materialize(vectors.transform(q, "qid", "text", vocab)
                     .join(q.select(F.col("qid").alias("id"), "block"), "id")
                     .select(F.col("id").alias("qid"), "block", "term", F.col("weight").alias("wq")))
    terms = materialize(vectors.weigh(fitted.counts, vocab)
                        .join(history.select(F.col("doc_id").alias("id"), "intent"), "id")
                        .select(F.col("id").alias("doc_id"), "intent", "term", F.col("weight").alias("wd")))
    return q, qt, build_index(terms)


def retrieve_topk(queries: DataFrame, history: DataFrame, k: int = 3,
                  min_df: int = 2, max_df: float = 0.95,
                  inputs_materialized: bool = False) -> DataFrame:
    """Top-k history documents per query.

    ``queries``: qid, text, intent.  ``history``: doc_id (unique), text,
    intent, plus any payload columns (returned with each hit).
    Output: qid, block, rank, doc_id, similarity, payload...
    """
    # Both inputs feed several branches (fit, blocks, pads, payload):
    # write each once instead of re-deriving it per branch.
    if not inputs_materialized:
        history = materialize(history)
    q, qt, index = postings(queries, history, min_df, max_df)
    hits = top_hits(qt, index, k)
    # Pad rows: k per block, looked up by the block key.
    pads = (q.select("qid", "block").join(pad_table(history, k), "block")
            .select("qid", "doc_id", F.lit(0.0).alias("similarity")))
    cands = (hits.unionByName(pads).groupBy("qid", "doc_id")
             .agg(F.max("similarity").alias("similarity")))
    top = materialize(_top_k(cands, k).select("qid", "doc_id", "similarity", "rank"))
    payload = [c for c in history.columns if c not in ("doc_id",)]
    return (history.select("doc_id", *payload).join(top, "doc_id")
            .join(q.select("qid", "block"), "qid")
            .select("qid", "block", F.col("rank").cast("int").alias("rank"), "doc_id",
                    "similarity", *payload))
