"""Small tables with the awkward cases that every operator must take."""

import random

WORDS = [a + b for a in ("ba", "do", "ke", "li", "mu", "ra", "so", "ti") for b in ("n", "st", "ria", "lo", "mp", "ver")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies string, row string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=1, n=40):
    """Prose with exact and near copies, NULLs, empty, blank and one very long text, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 90)) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t))
    for k in range(6):  # near copies of the first texts
        w = base[k].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, base[0]), (201, base[0]), (3, base[3]), (3, base[3])]  # equal texts; a row three times
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two three"), (304, "one two three"),
             (None, base[5]), (None, None), (305, prose(rng, 30_000)), (306, "é ü 日本 😀\n" + base[7])]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], None if k % 7 == 0 else f"s{k % 4}", None if t is None else len(t), 0.5, "x", None)
            for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
