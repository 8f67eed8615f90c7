import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from carelens.llm import cotrain, fingerprint as fp, license_scan as ls

from llm_helpers import SCHEMA, awkward, empty, frame, prose


# ---------------------------------------------------------------- licenses

def shingles(t):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_licenses_equal_containment(spark):
    rng = random.Random(4)
    names = list(ls.TEMPLATES)
    rows = [(r[0], r[1]) for r in awkward()]
    for k in range(60):
        name = names[k % len(names)]
        w = ls.TEMPLATES[name].split()
        if k % 3 == 1:  # an edit
            w[rng.randrange(len(w))] = "other"
        if k % 3 == 2:  # the last part is missing
            w = w[:max(5, len(w) * 9 // 10)]
        rows.append((700 + k, prose(rng, rng.randint(0, 80)) + "\n" + " ".join(w).upper() + "\n" + prose(rng, 10)))
    rows.append((800, "released under"))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, band int")
    got = sorted((r.doc_id, r.template) for r in ls.scan(docs).collect())
    want = []
    for i, t in rows:
        own = shingles(t)
        for name, text in ls.TEMPLATES.items():
            s = shingles(text)
            if 100 * len(s & own) >= 75 * len(s):
                want.append((i, name))
    assert got == sorted(want)
    assert ls.scan(empty(spark)).count() == 0 and ls.scan(docs, templates={}).count() == 0
    assert ls.collision_probability(0.16) > 0.98


def test_long_texts_take_linear_time(spark):
    """Thousands of notices in one text: eight times the text takes less than sixteen times as long."""
    notice = "Released under the MIT License. "
    took = {}
    for n in (500, 4000, 32_000):
        rng = random.Random(n)
        text = "".join(notice + prose(rng, k % 4) + " " for k in range(n))
        docs = spark.createDataFrame([(1, text, 7), (2, text + notice * 2000, 7)], "doc_id long, text string, g int")
        start = time.monotonic()
        got = sorted((r.doc_id, r.template, r.containment) for r in ls.scan(docs).collect())
        took[n] = time.monotonic() - start
        assert got == [(1, "MIT", 1.0), (2, "MIT", 1.0)]
    assert took[32_000] < 16 * max(took[4000], 2), took


# ------------------------------------------------------------ fingerprints

def test_next_documents_and_edits(spark):
    rows = awkward()
    got = fp.compare_with_edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    order = sorted((i for i in texts if i is not None and len(texts[i]) == 1), reverse=True)
    by_id = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:], strict=False):
        x, y = next(iter(texts[a])), next(iter(texts[b]))
        y = x if a == 3 else y
        if a == 3:
            continue  # repeated rows follow each other
        k = len(x) // 3
        want = x[:len(x) - k] + y[:k]
        assert by_id[a].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and by_id[a].n_chars == len(x)
    same = {r.fingerprint for r in got if r.doc_id in (0, 200, 201)}
    assert len(same) == 1 and by_id[1].fingerprint not in same
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert fp.compare_with_edits(empty(spark)).count() == 0
    one = fp.compare_with_edits(frame(spark, rows[:1])).first()
    assert one.near_next == 1.0


def test_sums_are_homomorphic(spark):
    rng = random.Random(6)
    lines = [prose(rng, 12) for _ in range(9)]
    parts = [(0, "\n".join(lines[:5])), (1, "\n".join(lines[5:])), (2, "\n".join(lines[::-1])), (3, "")]
    df = fp.sums(spark.createDataFrame(parts, "k int, t string"), ["k"], "t")
    whole = df.alias("a").join(df.alias("b"), (F.col("a.k") == 0) & (F.col("b.k") == 1)).select(
        fp.combine(F.col("a.fp"), F.col("b.fp")).alias("s"), F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    row = whole.select(fp.to_string(F.col("s")).alias("s"), fp.to_string(fp.combine(F.col("s"), F.col("b"), -1)).alias("d"),
                       fp.to_string(F.col("a")).alias("a")).first()
    plain = {r.k: r.f for r in df.select("k", fp.to_string(F.col("fp")).alias("f")).collect()}
    assert row.s == plain[2] and row.d == row.a == plain[0] and set(plain[3]) <= set("0-")


# ----------------------------------------------------------------- quality

def quality_rows(n=300):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(rng, rng.randint(20, 100))
        if bad:
            t = " | ".join(t.upper().split()) + "!!!"
        rows.append((i, t, "en", "bad" if bad and i % 8 else "good", len(t), 0.0, "c", "r"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_cotraining_held_out(spark):
    rows, labels = quality_rows()
    x = cotrain.features(frame(spark, rows), "doc_id", "text", ["source", "lang"], "n_chars").cache()
    y = spark.createDataFrame(labels, "id long, y int")
    model = cotrain.train(x, y.where("id % 5 in (1, 2, 3)"), rounds=2)
    got = model.score(x, ["id"]).join(y, "id").where("id % 5 = 0").collect()
    assert sum((r.score >= 0.5) == bool(r.y) for r in got) >= 0.97 * len(got)


def test_quality_awkward(spark):
    x = cotrain.features(frame(spark), "doc_id", "text", ["source", "lang"], "n_chars")
    none = spark.createDataFrame([], "id long, y int")
    one_class = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 0)], "id long, y int")
    for labels, share in ((none, 0.5), (one_class, 1.0)):
        got = cotrain.train(x, labels).score(x, ["id"]).collect()
        assert len(got) == len(awkward()) and {r.score for r in got} == {share}
    rows, labels = quality_rows(120)
    model = cotrain.train(cotrain.features(frame(spark, rows + awkward()), "doc_id", "text", ["source", "lang"], "n_chars"),
                          spark.createDataFrame(labels, "id long, y int"), rounds=1)
    assert all(0 <= r.score <= 1 for r in model.score(x, ["id"]).collect())
    nothing = cotrain.features(empty(spark), "doc_id", "text", ["source", "lang"], "n_chars")
    assert model.score(nothing, ["id"]).count() == 0 and cotrain.train(nothing, none).score(nothing, ["id"]).count() == 0
    assert SCHEMA.startswith("doc_id")
