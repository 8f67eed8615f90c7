"""Sparse TF-IDF as DataFrames.

Formulas of the reference vectorizer (1-2-grams, sublinear tf, smooth
idf, L2 rows):
  tf  = 1 + ln(count of term in doc)
  idf = ln((1 + n_docs) / (1 + df)) + 1
  w   = tf * idf / ||tf * idf||_2
Vocabulary: terms with ``df >= min_df`` and ``df <= max_df * n_docs``.

Layout: long tables ``(id, term, weight)``; a term is the 64-bit hash of its
string, so exchanges and joins move numbers. Strings are kept in one table with a
row per distinct term and its document frequency, written once (:func:`term_words`);
:func:`words` finds two strings of one hash there and refuses them. What a corpus
has per term and document is never stored: a document is one row, so its term
counts are taken inside the row, where they are weighed
(:mod:`carelens.operators.grams`). :func:`transform_in_slices` weighs one slice of the documents after the other,
so that what a join by term and the sum by document shuffle is on disk for a slice only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.functions import text as tx
from carelens.operators import grams
from carelens.session import importable, write_once

SLICES = 8  # of the documents, weighed one after the other

def _grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grams): tokens in their own projection, so the regex runs
    once per document and the bigram step reads its result."""
    toks = docs.select(F.col(id_col).alias("id"), tx.tokens(F.col(text_col)).alias("_toks"))
    return toks.select("id", tx.unigrams_and_bigrams(F.col("_toks")).alias("grams"))


# The *_outer generators are used on purpose: for a plain explode Catalyst
# infers a ``size(grams) > 0`` filter and pushes it below the exchange,
# which tokenises every document a second time in the scan stage. The
# outer form plus an explicit null filter keeps tokenising to one pass.

def ngrams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per (id, position, term): tokens then adjacent bigrams."""
    return (_grams(docs, id_col, text_col)
            .select("id", F.posexplode_outer("grams").alias("pos", "term"))
            .filter(F.col("term").isNotNull()))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf_count, word), counted inside each document's row."""
    toks = docs.select(F.col(id_col).alias("id"), tx.tokens(F.col(text_col)).alias("_toks"))
    importable(docs.sparkSession)
    counts = toks.mapInArrow(grams.counted, f"id {toks.dtypes[0][1]}, word string, tf_count bigint")
    return counts.select("id", F.xxhash64("word").alias("term"), "tf_count", "word")


def term_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, df): documents that hold each distinct string, counted first for the documents of a batch."""
    importable(docs.sparkSession)
    some = docs.select(tx.tokens(F.col(text_col)).alias("_toks")).mapInArrow(grams.held, "word string, df bigint")
    return some.groupBy("word").agg(F.sum("df").alias("df"))


@dataclass
class TfidfIndex:
    vocab: DataFrame    # term, df, idf
    weights: DataFrame  # id, term, weight  (L2-normalised rows)
    n_docs: object      # scalar Column (subquery)
    counts: DataFrame   # id, term, tf_count, word (taken from the documents at each use)
    words: DataFrame    # term, word, df (written once)
    words_path: str     # the folder of that table


def vocabulary(found: DataFrame, n_docs, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(term, df, idf) for the kept terms of ``found``: term, df."""
    df = found.groupBy("term").agg(F.sum("df").alias("df"))
    n = n_docs.cast("double")
    return (df.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
            .select("term", "df",
                    (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf")))


def words(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, word) of the kept terms; two strings of one hash raise an error."""
    pairs = counts.join(vocab.select("term"), "term", "left_semi").select("term", "word").distinct()
    clash = F.raise_error(F.concat(F.lit("two terms share a hash: "), F.min("word"), F.lit(", "), F.max("word")))
    return pairs.groupBy("term").agg(
        F.when(F.count("*") > 1, clash.cast("string")).otherwise(F.min("word")).alias("word"))


def weigh(counts: DataFrame, vocab: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Apply sublinear tf and idf, keep vocabulary terms, L2-normalise
    per id. Unknown terms drop out (inner join). ``keep``: columns of the vocabulary."""
    raw = (counts.join(vocab.select("term", "idf", *keep), "term")
           .select("id", "term", *keep,
                   ((F.lit(1.0) + F.log(F.col("tf_count").cast("double"))) * F.col("idf")).alias("raw")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", *keep, (F.col("raw") / norm).alias("weight"))


def fit_tfidf(docs: DataFrame, id_col: str, text_col: str,
              min_df: int = 2, max_df: float = 0.95) -> TfidfIndex:
    found, path = write_once(term_words(docs, id_col, text_col), "words", compression="zstd")
    found = found.withColumn("term", F.xxhash64("word"))  # not stored: hashes do not compress
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    vocab = vocabulary(found, n_docs, min_df, max_df)
    counts = term_counts(docs, id_col, text_col)
    return TfidfIndex(vocab=vocab, weights=weigh(counts, vocab), n_docs=n_docs, counts=counts, words=found, words_path=path)


def transform(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Vectorise new documents with a fitted vocabulary."""
    return weigh(term_counts(docs, id_col, text_col).drop("word"), vocab, keep)


def transform_in_slices(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Like :func:`transform`, written slice by slice; a slice holds whole documents, dealt by the hash of the id."""
    of = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SLICES))
    done = [write_once(transform(docs.where(of == k), id_col, text_col, vocab, keep)
                       .select("id", *(keep or ["term"]), F.round("weight", 6).alias("weight")), "weights", compression="zstd")[0]
            for k in range(SLICES)]
    return reduce(DataFrame.unionAll, done)
