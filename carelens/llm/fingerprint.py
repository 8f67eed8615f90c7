"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph is a non-empty line. Each is hashed to a wide vector of two
parts, and a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane, so it does not depend on their order, and a paragraph is
inserted or deleted by adding or subtracting its vector:

* ``wide``: ``WIDE`` lanes of 32 bits hashed from the whole paragraph, summed
  modulo 2^32. Equal multisets have equal sums; others collide with
  negligible probability.
* ``near``: 64 counters of 32 bits, two in a long, and ``n_near``: each
  five-word shingle of the paragraph adds its 64 hash bits. Read as +1/-1
  they are random projections of the shingle counts, so scalar products of
  two fingerprints estimate those of the documents.

All expressions are native; sums never leave 63 bits below 2^31 shingles or
paragraphs in a document.

Edge cases: NULL and empty texts, and texts of blank lines, have the zero
fingerprint; two zero fingerprints are alike (1), a zero and another are not
(0); repeated rows have equal fingerprints; a NULL id comes after all others
in descending order; rows of one id are ordered by a hash of the text; the
only row of a table is its own next; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.llm.common import written

WIDE = 8
SHINGLE = 5
PAIRS = 32  # longs of two counters
LOW = 0xFFFFFFFF
ONES = (1 << 32) | 1


# ------------------------------------------------------------ fingerprints

def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _shingles(h: Column) -> Column:
    """Hashes of five consecutive words; ``h`` must be a column, as it is read at every place."""
    last = F.greatest(F.size(h) - SHINGLE, F.lit(0))
    return F.when(h.isNotNull(), F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])))


def sums(texts: DataFrame, keys: list[str], text_col: str, version: str | None = None,
         names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """``keys`` with a struct ``wide, near, n_near`` of each row's text.

    ``keys`` identify a document. With ``version``, a document has a row per
    version 0, 1, ... and gets a struct of each, under ``names``. Paragraphs
    and shingles are expanded and summed in the task that reads the row; one
    line per document is shuffled.
    """
    carried = [*keys, *([version] if version else [])]
    p = texts.select(*carried, F.explode_outer(paragraphs(F.col(text_col))).alias("p"))
    p = p.withColumn("h", F.transform(F.split("p", " "), lambda w: F.xxhash64(w)))
    s = p.select(*carried, "p", F.posexplode_outer(_shingles(F.col("h"))).alias("i", "s"))
    aggs = []
    for v, name in enumerate(names):
        here = F.col(version) == v if version else F.lit(True)
        for k in range(WIDE // 2):
            h = F.when(here & (F.col("i") == 0), F.xxhash64("p", F.lit(k)))
            aggs += [F.sum(h.bitwiseAND(F.lit(LOW))).alias(f"{name}w{2 * k}"),
                     F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}w{2 * k + 1}")]
        one = F.when(here, F.col("s"))
        for k in range(PAIRS):
            aggs.append(F.sum(F.shiftrightunsigned(one, k).bitwiseAND(F.lit(ONES))).alias(f"{name}c{k}"))
        aggs.append(F.count(one).alias(f"{name}n"))
    got = s.groupBy(*keys).agg(*aggs)
    zero = F.lit(0).cast("long")
    return got.select(*keys, *[F.struct(
        F.array(*[F.coalesce(F.col(f"{n}w{k}"), zero).bitwiseAND(F.lit(LOW)) for k in range(WIDE)]).alias("wide"),
        F.array(*[F.coalesce(F.col(f"{n}c{k}"), zero) for k in range(PAIRS)]).alias("near"),
        F.col(f"{n}n").alias("n_near")).alias(n) for n in names])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint structs added (or, with -1, subtracted) lane by lane."""
    def lanes(x: Column, y: Column) -> Column:
        lo = (x.bitwiseAND(F.lit(LOW)) + sign * y.bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
        hi = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(LOW))
        return F.shiftleft(hi, 32).bitwiseOR(lo)
    return F.struct(
        F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW))).alias("wide"),
        F.zip_with(a["near"], b["near"], lanes).alias("near"),
        (a["n_near"] + sign * b["n_near"]).alias("n_near"))


def to_string(fp: Column) -> Column:
    """Hexadecimal text: wide lanes, shingle count, counters."""
    def digits(x: Column, n: int) -> Column:
        return F.lpad(F.hex(x), n, "0")
    return F.lower(F.concat(
        F.array_join(F.transform(fp["wide"], lambda x: digits(x, 8)), ""), F.lit("-"),
        F.hex(fp["n_near"]), F.lit("-"),
        F.array_join(F.transform(fp["near"], lambda x: digits(x, 16)), "")))


def _counters(x: Column, n: Column) -> tuple[Column, Column]:
    return (2 * x.bitwiseAND(F.lit(LOW)) - n).cast("double"), (2 * F.shiftrightunsigned(x, 32) - n).cast("double")


def _product(a: Column, b: Column) -> Column:
    def pair(x: Column, y: Column) -> Column:
        (xl, xh), (yl, yh) = _counters(x, a["n_near"]), _counters(y, b["n_near"])
        return xl * yl + xh * yh
    return F.aggregate(F.zip_with(a["near"], b["near"], pair), F.lit(0.0), lambda t, x: t + x)


def likeness(a: Column, b: Column) -> Column:
    """Twice the scalar product over the squared lengths, within 0..1."""
    size = _product(a, a) + _product(b, b)
    same = (a["wide"] == b["wide"]) & (a["n_near"] == b["n_near"])
    ratio = F.when(size > 0, 2 * _product(a, b) / size).otherwise(0.0)
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


# --------------------------------------------------------- next documents

def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tie, text, next_id, next_tie, next_text`` in descending id order, cyclic.

    Ids are cut at quantiles to ranges; a row's next is found by a window
    inside its range, whose end gets a copy of the first row of the range
    after it. Texts are shuffled once and no task holds more than a range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.lit("tie")).alias("tie"), text.alias("text"))
    ranges = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx(
        F.col(id_col), [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    lower = F.size(F.filter(bounds, lambda c: c > F.col("id")))
    ranged = rows.withColumn("part", F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(lower))
    # One line per range: its first row. They number at most ``ranges`` + 1.
    key = F.struct(F.col("id"), -F.col("tie").cast("decimal(20,0)"), F.col("tie"))
    heads = ranged.select("part", "id", "tie").groupBy("part").agg(F.max(key).alias("k")).orderBy("part").collect()
    if not heads:
        return rows.select("*", F.col("id").alias("next_id"), F.col("tie").alias("next_tie"),
                           F.col("text").alias("next_text"))
    before = [(h["k"]["id"], h["k"]["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    types = f"hid {rows.schema['id'].dataType.simpleString()}, htie long, to int"
    moved = spark.createDataFrame(before, types)
    ghosts = ranged.join(F.broadcast(moved), F.col("id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie"))) \
        .select("id", "tie", "text", F.col("to").alias("part"), F.lit(1).alias("ghost"))
    both = ranged.select("id", "tie", "text", "part", F.lit(0).alias("ghost")).unionAll(ghosts)
    order = Window.partitionBy("part").orderBy("ghost", F.col("id").desc_nulls_last(), "tie")
    return (both.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("id", "tie", "text")})
            .where("ghost = 0").drop("ghost", "part"))


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many first ones of the next text."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""
    pairs = with_next(docs, id_col, text_col)
    rows = pairs.select(
        F.monotonically_increasing_id().alias("row"), "id", "tie", "next_id", "next_tie",
        F.char_length("text").cast("long").alias("n_chars"), "text",
        edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    versions = rows.select(
        "row", "id", "tie", "next_id", "next_tie", "n_chars",
        F.unhex(F.sha2("edited", 256)).alias("sha"), F.inline(F.array(
            F.struct(F.lit(0).alias("v"), F.col("text").alias("t")),
            F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))))
    keys = ["row", "id", "tie", "next_id", "next_tie", "n_chars", "sha"]
    one = written(sums(versions, keys, "t", "v", ("own", "edited")), "fingerprints")
    right = one.groupBy(F.col("id").alias("rid"), F.col("tie").alias("rtie")).agg(F.first("own").alias("following"))
    got = one.join(right, F.col("next_id").eqNullSafe(F.col("rid")) & (F.col("next_tie") == F.col("rtie")))
    return got.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        to_string(F.col("own")).alias("fingerprint"), to_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
