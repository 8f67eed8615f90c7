"""Mixing sources to target weights by Pareto order sampling.

Targets are water-filled: each source's share by weight, none above
``cap`` times its size, what is over going to the others by weight. A
source's target over its size is the rate of copies of its documents: the
whole part is taken for certain, for every document alike; the rest is an
unequal-probability sample of fixed size (in words). Pareto order sampling
ranks a document by random odds over inclusion odds,
``(u / (1 - u)) / odds``, and takes documents in that order until the words
left are used up. Odds within a source are proportional to the square root
of the document's size (damped length); their common factor does not change
the order, so it need not be solved for.

The cut is found without gathering a source in one task: ranks fall into
``CELLS`` cells per source, cell sums are scanned, and only the one cell of
each source that holds the cut is ordered document by document.

``u`` is a hash of the id and a seed, so reruns agree. Everything is
DataFrame operations.

Edge cases: NULL and empty texts have size 0 and take nothing; a NULL
source is a source, ordered last; repeated rows are documents of their own
with the same rank, ordered by size; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.llm.common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
CELLS = 65536
SEED = "mix-1"


def text_size(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return (bits + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``src, source_size, target`` of every source, water-filled under the caps.

    A source is held at its cap as long as its cap per weight lies below
    the level that the others would get; in order of cap per weight these
    sources come first, so one scan over the sources finds the level.
    """
    n = len(weights)
    per = sizes.groupBy("src").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % n + 1).cast("int")))
    per = per.withColumn("top", F.col("source_size") * F.lit(cap))
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("top") / F.col("w"), F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("source_size").over(everywhere) * F.lit(share))
           .withColumn("capped", F.coalesce(F.sum("top").over(before), F.lit(0.0)))
           .withColumn("w_left", F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           .withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_left")))
    # The first source, in this order, that its level does not fill sets the level of all after it.
    fills = F.col("top") <= F.col("level") * F.col("w")
    level = F.min(F.when(~fills, F.struct(F.col("top") / F.col("w"), F.coalesce("src", F.lit("")), "level")))
    per = per.withColumn("found", level.over(everywhere)["level"])
    held = F.coalesce(F.col("top") <= F.col("found") * F.col("w"), F.lit(True))
    target = F.when(held, F.col("top")).otherwise(F.col("found") * F.col("w"))
    return per.select("src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    keep_row: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    ``keep_row`` adds the whole input row as the struct column ``row``. The
    decision is made beside each row from a table of one line per source,
    so texts are not shuffled (but for the rows of the cells with a cut).
    """
    keys = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"),
            text_size(F.col(text_col)).alias("size")]
    sized = written(docs.select(*keys), "mix-sizes")
    per = _cuts(sized, source_targets(sized, weights, share, cap), seed)
    base = docs.select(F.struct("*").alias("row"), *keys) if keep_row else sized
    carried = [*(["row"] if keep_row else []), "id", "src", "size", "source_size", "target", "whole", "extra"]
    joined = _ranked(base, seed).alias("d").join(per.alias("t"), F.col("d.src").eqNullSafe(F.col("t.src"))).select(
        "d.*", "source_size", "target", "whole", "left", "cut", "before", "last_full")
    inside = Window.partitionBy("src").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = joined.where(F.col("cell") == F.col("cut"))
    at_cut = at_cut.withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at_cut = at_cut.withColumn("extra", (2 * F.col("run") + F.col("size") <= 2 * F.col("left")).cast("long"))
    rest = joined.where(F.col("cut").isNull() | (F.col("cell") != F.col("cut")))
    rest = rest.withColumn("extra", F.coalesce(F.col("cell") <= F.col("last_full"), F.lit(False)).cast("long"))
    both = at_cut.select(*carried).unionAll(rest.select(*carried))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return both.select(
        *(["row"] if keep_row else []),
        F.col("id").alias(id_col), F.col("src").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _ranked(sized: DataFrame, seed: str) -> DataFrame:
    """Adds the Pareto rank ``q`` and its ``cell``."""
    u = uniform(F.col("id"), seed)
    odds = F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double"))
    q = u / (1 - u) / odds
    return sized.withColumn("q", q).withColumn("cell", F.floor(q / (q + 1) * CELLS).cast("int"))


def _cuts(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Per source: certain copies, words left, and where its cells are cut."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    per = written(targets.withColumn("whole", whole).withColumn(
        "left", F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))), "mix-targets")
    cells = _ranked(sized, seed).groupBy("src", "cell").agg(F.sum("size").alias("in_cell"))
    earlier = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)))
    upto = F.col("before") + F.col("in_cell")
    holds_cut = (F.col("before") < F.col("left")) & (upto > F.col("left"))
    found = (cells.alias("c").join(per.select("src", "left").alias("t"), F.col("c.src").eqNullSafe(F.col("t.src")))
             .groupBy(F.col("t.src").alias("src")).agg(
                 F.max(F.when(holds_cut, F.col("cell"))).alias("cut"),
                 F.max(F.when(holds_cut, F.col("before"))).alias("before"),
                 F.max(F.when(upto <= F.col("left"), F.col("cell"))).alias("last_full")))
    return written(per.alias("t").join(found.alias("k"), F.col("k.src").eqNullSafe(F.col("t.src")), "left")
                   .select("t.*", "cut", "before", "last_full"), "mix-cuts")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    taken = mix(docs, keep_row=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
