"""What TF-IDF writes: a row per distinct term, and weights slice by slice."""

from pyspark.sql import functions as F

from carelens.operators import vectors
from carelens.session import materialize


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is None, str(x)) for x in r))


def documents(spark):
    texts = [(1, "red apple pie"), (2, "red apple red apple"), (2, "green apple pie"), (3, None), (4, ""),
             (None, "red pie and green pie"), (None, "green apple"), (5, "a lone word nowhere")]
    return materialize(spark.createDataFrame(texts, "id long, t string"))


def test_fit_stores_a_row_per_distinct_word(spark):
    d = documents(spark)
    idx = vectors.fit_tfidf(d, "id", "t", max_df=1.0)
    grams = vectors.term_counts(d, "id", "t")
    want = grams.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    assert rows(idx.words.select("word", "df")) == rows(want)
    assert spark.read.parquet(idx.words_path).columns == ["word", "df"]
    kept = {r.word: r.df for r in want.collect() if r.df >= 2}
    named = idx.vocab.join(vectors.words(idx.words, idx.vocab), "term")
    assert {r.word: r.df for r in named.collect()} == kept and kept


def test_slices_give_the_weights_of_the_whole(spark):
    d = documents(spark)
    idx = vectors.fit_tfidf(d, "id", "t", max_df=1.0)
    named = materialize(idx.vocab.join(vectors.words(idx.words, idx.vocab), "term"))
    whole = vectors.transform(d, "id", "t", named, keep=["word"]).select("id", "word", F.round("weight", 6).alias("weight"))
    assert rows(vectors.transform_in_slices(d, "id", "t", named, keep=["word"])) == rows(whole)
    assert whole.where("id is null").count() > 0
