import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from carelens.llm import registry, token_shards
from carelens.llm.common import written

from llm_helpers import prose
from test_decontaminate import brute as brute_hits
from test_ngram_join import brute as brute_components

BAD = ["horrid", "wretch", "vermin"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables with toxic, copied and leaking documents."""
    rng = random.Random(11)
    items = [(k, prose(rng, 30)) for k in range(3)]
    rows, labels = [], []
    for i in range(160):
        w = prose(rng, rng.randint(30, 90)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        t = " ".join(w)
        if i % 20 == 1:
            t += " " + items[i % 3][1]
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(900 + k, rows[k * 4 + 1][1], "en", "s0", 1) for k in range(10)]
    rows += [(950, None, None, None, None), (951, "", "en", None, 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, dict((i, t) for i, _, t in labels), items


def test_stages(spark, corpus):
    path, rows, toxic, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, path), name)
        kept.append(out)
        if name != cp.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    after = [[(r.doc_id, r.text) for r in df.collect()] for df in kept[:4]]
    # Toxic documents go, others stay.
    gone = {r[0] for r in rows} - {i for i, _ in after[0]}
    wrong = {i for i in gone if not toxic.get(i)} | {i for i, t in toxic.items() if t and i not in gone}
    assert len(wrong) <= 4
    # One document of each component of what is left.
    comp = brute_components(after[0])
    assert sorted(i for i, _ in after[1]) == sorted(i for i, _, c in comp if i == c)
    # Same documents, no benchmark window left, others unchanged.
    assert sorted(i for i, _ in after[2]) == sorted(i for i, _ in after[1])
    assert not any(r[5] for r in brute_hits(after[2], items))
    clean = {r[0] for r in brute_hits(after[1], items) if not r[5]}
    assert {i: t for i, t in after[2] if i in clean} == {i: t for i, t in after[1] if i in clean}
    # Whole documents, at most twice.
    texts = dict(after[2])
    counts = {}
    for i, t in after[3]:
        assert t == texts[i]
        counts[i] = counts.get(i, 0) + 1
    assert set(counts.values()) <= {1, 2}
    # The tokens are those of the mixed documents.
    enc, end = token_shards.encoding(registry.RANKS)
    n_tokens = sum(len(enc.encode_ordinary(t or "")) + 1 for _, t in after[3])
    assert sum(r.n_tokens for r in kept[4].collect()) == n_tokens
    assert {i for r in kept[4].collect() for i in r.doc_ids} == set(counts)


def test_run_equals_its_stages(spark, corpus):
    path = corpus[0]
    shards = cp.run(spark, path).collect()
    assert sum(len(r.payload) // r.stride for r in shards) == sum(r.n_slots for r in shards)
    stream = np.concatenate([np.frombuffer(r.payload, token_shards.DTYPE) for r in shards])
    assert len(stream) % token_shards.SEQ_LEN == 0


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_columns_of_any_name_pass_through(spark, corpus, tmp_path):
    """Extra columns named like the operators' own keep their values through every stage."""
    path, rows, _, _ = corpus
    extra = {"items": "doc_id + 1", "spans": "cast(doc_id as string)", "n_words": "1", "row": "doc_id", "score": "0.5D",
             "copies": "'c'", "n_shingles": "doc_id", "representative": "true", "size": "2", "tkey": "doc_id"}
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 60 or doc_id >= 940").selectExpr(
        "*", *[f"{e} as {c}" for c, e in extra.items()])
    want = {r.doc_id: r for r in docs.collect()}
    docs = written(docs, "clashing")
    for name, stage in cp.STAGES[:4]:
        out = written(stage(spark, docs, path), name)
        assert out.columns == docs.columns, name
        docs = out
    got = docs.collect()
    assert got and all(r[c] == want[r.doc_id][c] for r in got for c in extra)


def test_an_empty_table_goes_through(spark, corpus):
    path, _, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, path), name)
    assert docs.count() == 0
