"""Physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from carelens.operators import pairing, profiling, vectors
from carelens.plans import catalog
from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_group_uses_partial_window_group_limit(spark):
    p = plan(profiling.top_authors(catalog.messages(spark, SF_SMALL)))
    assert "WindowGroupLimit" in p


def test_keep_last_aggregates_partially(spark):
    p = plan(pairing.keep_last(catalog.messages(spark, SF_SMALL)))
    assert "partial_max" in p
    assert "Window" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = catalog.messages(spark, SF_SMALL).filter(F.col("inbound")).select("tweet_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in p or "text" not in p.split("ReadSchema")[1][:80]
    assert "PushedFilters" in p


def test_unused_reply_link_join_is_removed(spark):
    df = catalog.messages(spark, SF_SMALL).select("tweet_id", "inbound")
    assert "Join" not in plan(df)


def test_term_counts_need_no_shuffle(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert "Exchange" not in plan(vectors.term_counts(d, "doc_id", "text"))
    counts = {(r.id, r.word): r.tf_count for r in vectors.term_counts(
        spark.createDataFrame([(1, "aa bb aa aa bb"), (2, ""), (3, None)], "id long, t string"), "id", "t").collect()}
    assert counts == {(1, "aa"): 3, (1, "bb"): 2, (1, "aa bb"): 2, (1, "bb aa"): 1, (1, "aa aa"): 1}


def exchanges(df):
    """What each exchange of a plan carries."""
    qe = df._jdf.queryExecution()
    out, todo = [], [qe.executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.initialPlan())
            continue
        if p.nodeName() == "Exchange":
            out.append(p.schema().simpleString())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_terms_are_numbers_in_every_exchange(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    idx = vectors.fit_tfidf(d, "doc_id", "text")
    found = exchanges(idx.vocab) + exchanges(idx.weights)
    assert found and not any("string" in e for e in found), found


def test_two_words_of_one_hash_are_refused(spark):
    import pytest
    counts = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (1, 8, "c")], "id long, term long, word string")
    vocab = spark.createDataFrame([(7,), (8,)], "term long")
    with pytest.raises(Exception, match="share a hash"):
        vectors.words(counts, vocab).collect()
    assert [r.word for r in vectors.words(counts.where("word <> 'b'"), vocab).orderBy("term").collect()] == ["a", "c"]


def test_upper_median_of_a_million_distinct_values(spark):
    """Exact for odd, even, repeated, negative and NULL values; no aggregate keeps a group's values."""
    rows = spark.range(1_000_000).select(F.lit("hot").alias("brand"), (F.col("id") * 7 % 1_000_003 - 300_000).cast("int").alias("x"))
    few = spark.createDataFrame(
        [("even", v) for v in (5, 1, 9, 9)] + [("odd", v) for v in (-70_000, 70_000, 3)] + [("one", 0), ("none", None),
         ("even", None), (None, 4), (None, 6)], "brand string, x int")
    both = rows.unionAll(few)
    counts = both.groupBy("brand", "x").agg(F.count(F.lit(1)).alias("n"))
    got = profiling.upper_medians(counts, "brand", "x", "n")
    want = {}
    for r in few.where("x is not null").collect():
        want.setdefault(r.brand, []).append(r.x)
    want["hot"] = [i * 7 % 1_000_003 - 300_000 for i in range(1_000_000)]
    want = {b: sorted(v)[len(v) // 2] for b, v in want.items()}
    assert {r.brand: r["median"] for r in got.collect()} == want and want["even"] == 9 and want[None] == 6
    assert "ObjectHashAggregate" not in plan(got) and "percentile" not in plan(got)
    repeated = counts.unionAll(counts)  # several rows of one value
    again = {r.brand: r["median"] for r in profiling.upper_medians(repeated, "brand", "x", "n").collect()}
    assert again["hot"] == want["hot"] and again["odd"] == 3
