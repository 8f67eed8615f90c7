"""Toxicity: noisy-channel deobfuscation, then a score on the restored text.

**Character language model.** Trigram counts of letters over the alphabetic
word types of every document, weighted by their occurrences; tasks count,
one aggregation of at most 64^3 cells joins them.

**Channel.** A word that shows signs of disguise (a digit or symbol among
letters, look-alikes only with a symbol among them, a letter three or more times in a row, single letters set apart by
spaces or marks) becomes a lattice: every surface character may stand for
the letters that look like it, a symbol may stand for nothing, a repeated
letter may be an echo, a gap between single letters may be nothing or a word
boundary. Viterbi decoding under the character model picks the restored
words. A word without such signs has one path and is taken as it is. A
symbol three or more times in a row is decoration and stands for nothing.

**Score.** On the restored words: character n-grams with word boundaries
are weighed by how much more often toxic labelled documents hold them than
others (lower confidence bound of the log ratio, so rare n-grams count for
little); a word's weight is its best n-gram; a document's features are its
three heaviest distinct words, what the first two have beyond ``SURE``, and
the number of heavy ones, whatever its length; a logistic regression maps them to 0..1. N-grams are weighed on one
part of the labelled rows and the regression fitted on the other.

Labels come from a bounded, documented sample (``FIT_ROWS`` ids a class,
lowest id hash first) of the rows allowed for training; all else covers
every document.

Edge cases: NULL and empty texts have no words and get the score of zero
features; labels without an id, or other than 0 and 1, are not used; an id
labelled twice counts as toxic if either row says so; with labels of one
class only, the score is that of the prior; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import lean, written

FIT_ROWS = 4000
CACHE_WORDS = 200_000
GRAM_BITS = 22
GRAM_SIZES = (3, 4, 5, 6)
HEAVY = 1.0
SURE = 2.0

# Surface characters and the letters that they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "}": "",
    "€": "e", "£": "l", "¥": "y", "¡": "i", "§": "s", "µ": "u", "%": "", "#": "h", "&": "", "*": "aeiou",
    "^": "a", "~": "", "=": "", "_": "", "-": "", ".": "", "'": "", "/": "", "\\": "", ",": "", ":": "",
    ";": "", "?": "", '"': "", ")": "", "]": "", ">": "", "`": "",
}

COST_SAME, COST_LOOK, COST_LOOK_WILD, COST_DROP, COST_ECHO = 0.0, 0.7, 2.5, 1.5, 0.4
COST_JOIN, COST_SPLIT = 0.3, 2.0

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()) + "œşğı"
_CODE = {ch: i + 2 for i, ch in enumerate(_LETTERS)}
OTHER, EDGE, SIGMA = 1, 0, 64

_TRIM = ".,;:!?\"'()[]{}«»…“”‘’"
_RUN = re.compile(r"(.)\1\1")
_DECOR = re.compile(r"([^\w\s])\1\1+")


def code(ch: str) -> int:
    return _CODE.get(ch, OTHER)


# ------------------------------------------------------- character model

def trigram_counts(types: Counter) -> np.ndarray:
    """Letter trigrams of alphabetic words, weighted, as a SIGMA^3 vector."""
    ws = [(w, n) for w, n in types.items() if w.isalpha()]
    out = np.zeros(SIGMA ** 3)
    for start in range(0, len(ws), 50_000):
        part = ws[start:start + 50_000]
        text = "".join(f"\0\0{w}\0" for w, _ in part)
        table = {ch: code(ch) for ch in set(text)}
        table["\0"] = EDGE
        c = np.fromiter(map(table.__getitem__, text), np.int64, len(text))
        length = np.array([len(w) + 3 for w, _ in part])
        weight = np.repeat(np.array([n for _, n in part], float), length)
        tri = (c[:-2] * SIGMA + c[1:-1]) * SIGMA + c[2:]
        last = np.cumsum(length)
        inside = np.ones(len(text), bool)
        inside[last - 1] = inside[last - 2] = False  # would reach into the next word
        out += np.bincount(tri[inside[:-2]], weight[:-2][inside[:-2]], minlength=len(out))
    return out


def count_language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over every document (at most SIGMA^3 cells reach the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(SIGMA ** 3), Counter()
        for batch in batches:
            for x in batch.column(0):
                t = x.as_py()
                if t:
                    types.update(t.lower().split())
            if len(types) > CACHE_WORDS:
                total += trigram_counts(types)
                types = Counter()
        total += trigram_counts(types)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    cells = docs.select(F.col(text_col).alias("t")).mapInArrow(lean(run), "cell int, n double")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIGMA ** 3)
    out[got["cell"].to_numpy(int)] = got["n"].to_numpy()
    return out


def language_model(counts: np.ndarray) -> list[float]:
    """Negative log probabilities, trigrams smoothed by bigrams and letters."""
    tri = counts.reshape(SIGMA, SIGMA, SIGMA)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 0.5) / (uni + 0.5).sum()
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return (-np.log(p3)).ravel().tolist()


# --------------------------------------------------------------- decoding

def disguised(core: str) -> bool:
    """Whether a lower-cased word without outer punctuation needs the lattice."""
    if core.isalpha():
        return _RUN.search(core) is not None
    if any(map(str.isalpha, core)):
        return True
    # Look-alikes only: a word if a symbol may stand for a letter, else a number.
    return all(ch in LOOKALIKES for ch in core) and any(LOOKALIKES[ch] and not ch.isdigit() for ch in core)


def viterbi(surface: str, lm: list[float]) -> list[str]:
    """The cheapest restored words of a surface string; blanks are gaps.

    One pass over the whole string: the two letters before bound the states,
    and a state's text is a chain of back pointers, of which states share all
    but their last few, so time and memory are linear in the length.
    """
    # state: (letter before, last letter) -> (cost, (chain before, last characters))
    states: dict = {(EDGE, EDGE, ""): (0.0, None)}
    # Only characters of a run of three or more may be echoes: doubles are ordinary.
    marks = [k for k, ch in enumerate(surface) if ch.isalnum() or len(LOOKALIKES.get(ch, "")) > 0]
    echoing = set()
    for a, b, c in zip(marks, marks[1:], marks[2:], strict=False):
        if surface[a] == surface[b] == surface[c]:
            echoing.update((a, b, c))
    for k, ch in enumerate(surface):
        nxt: dict = {}

        def offer(key, cost, chain, add, nxt=nxt):
            if key not in nxt or cost < nxt[key][0]:
                nxt[key] = (cost, (chain, add) if add else chain)

        for (a, b, last), (cost, chain) in states.items():
            base = (a * SIGMA + b) * SIGMA
            if ch == " ":
                offer((a, b, last), cost + COST_JOIN, chain, "")
                if b != EDGE:
                    offer((EDGE, EDGE, ""), cost + COST_SPLIT + lm[base + EDGE], chain, " ")
                continue
            if ch.isalpha():
                c = code(ch)
                offer((b, c, ch), cost + COST_SAME + lm[base + c], chain, ch)
                if ch == last and k in echoing:
                    offer((a, b, last), cost + COST_ECHO, chain, "")
                continue
            looks = LOOKALIKES.get(ch, "")
            price = COST_LOOK_WILD if len(looks) > 2 else COST_LOOK
            for x in looks:
                c = code(x)
                offer((b, c, x), cost + price + lm[base + c], chain, x)
                if x == last and k in echoing:
                    offer((a, b, last), cost + COST_ECHO, chain, "")
            offer((a, b, last), cost + COST_DROP, chain, "")
        states = nxt
    ends = [(cost + (lm[(a * SIGMA + b) * SIGMA + EDGE] if b != EDGE else 0.0), chain)
            for (a, b, _), (cost, chain) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_text(chain) for cost, chain in ends if cost == least).split()


def _text(chain: tuple | None) -> str:
    """The characters of a chain of back pointers, first to last."""
    out = []
    while chain is not None:
        chain, ch = chain
        out.append(ch)
    return "".join(reversed(out))


def restore_word(word: str, lm: list[float]) -> list[str]:
    """Restored words of one lower-cased token."""
    if word.isalpha():  # nothing to trim
        return viterbi(word, lm) if disguised(word) else [word]
    core = _DECOR.sub("", word).strip(_TRIM)
    if not core or core.isalpha() and not disguised(core):
        return [core] if core else []
    if not disguised(core):
        return [core]
    return viterbi(core, lm)


def _units(text: str) -> list[str]:
    """Lower-cased tokens in order; three or more single characters in a row form one with blanks."""
    text = text.lower()
    tokens = (text if text.isascii() else unicodedata.normalize("NFC", text)).split()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(single) < 3:
        return tokens
    out, last, k = [], 0, 0
    while k < len(single):
        e = k
        while e + 1 < len(single) and single[e + 1] == single[e] + 1:
            e += 1
        if e - k >= 2:
            out += tokens[last:single[k]]
            out.append(" ".join(tokens[single[k]:single[e] + 1]))
            last = single[e] + 1
        k = e + 1
    return out + tokens[last:]


def restore(text: str, lm: list[float]) -> str:
    """The restored text: its words in order, one blank between."""
    return " ".join(w for t in _units(text) for w in restore_token(t, lm))


def restore_token(token: str, lm: list[float]) -> list[str]:
    """Like :func:`restore_word`, also for a token of set-apart characters."""
    if " " in token:
        return viterbi(token, lm)
    return restore_word(token, lm)


# ---------------------------------------------------------------- scoring

def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words with boundaries: ids, and word of each id."""
    text = "".join(f"^{w}$" for w in words)
    length = np.array([len(w) + 2 for w in words], np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(length), length)
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(c))
    ids, own = [], []
    h = np.zeros(len(c), np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    for k in range(max(GRAM_SIZES)):
        n = len(c) - k
        if n <= 0:
            break
        h = (h[:n] ^ c[k:]) * mul
        h ^= h >> np.uint64(29)
        if k + 1 in GRAM_SIZES:
            ok = at[:n] + k < end[:n]
            ids.append((h[ok] * mul >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
            own.append(owner[:n][ok])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(own)


class WordWeights:
    """Weight of every surface token seen so far, with a bounded cache."""

    def __init__(self, lm: list[float], weights: np.ndarray):
        self.lm, self.weights, self.cache = lm, weights, {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        new = list(tokens.difference(self.cache))
        if not new:
            return
        restored = [restore_token(t, self.lm) for t in new]
        words = sorted({w for ws in restored for w in ws})
        weight = {}
        if words:
            ids, own = gram_ids(words)
            best = np.zeros(len(words))
            np.maximum.at(best, own, self.weights[ids])
            weight = dict(zip(words, best.tolist(), strict=True))
        for t, ws in zip(new, restored, strict=True):
            self.cache[t] = max((weight[w] for w in ws), default=0.0)

    def features(self, text: str | None) -> list[float]:
        tokens = set(_units(text)) if text else set()
        self.learn(tokens)
        get = self.cache.__getitem__
        w = [x for x in map(get, tokens) if x > 0]
        w.sort(reverse=True)
        heavy = sum(1 for x in w if x > HEAVY)
        top = [*w[:3], 0.0, 0.0, 0.0]
        sharp = [max(0.0, x - SURE) for x in top[:2]]
        return [top[0], top[1], top[2], *sharp, math.log1p(heavy), heavy / math.sqrt(max(1, len(tokens)))]


N_FEATURES = 7


def _gram_counts(lm: list[float]):
    """Documents of either class that hold each n-gram, over labelled rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                t = x.as_py()
                tokens = set(_units(t)) if t else set()
                if len(cache) > CACHE_WORDS:
                    cache = {}
                new = list(tokens.difference(cache))
                if new:
                    restored = [restore_token(k, lm) for k in new]
                    words = [" ".join(r) for r in restored]
                    parts = [w.split() for w in words]
                    flat = [w for p in parts for w in p]
                    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                    ids, own = gram_ids(flat) if flat else (np.zeros(0, np.int64),) * 2
                    tok = of[own] if len(own) else own
                    order = np.argsort(tok, kind="stable")
                    cut = np.searchsorted(tok[order], np.arange(len(new) + 1))
                    for k, token in enumerate(new):
                        cache[token] = ids[order[cut[k]:cut[k + 1]]]
                grams = np.unique(np.concatenate([cache[k] for k in tokens])) if tokens else np.zeros(0, np.int64)
                n = totals.setdefault(y, np.zeros(1 << GRAM_BITS, np.int32))
                n[grams] += 1
        for y, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([y] * len(at), pa.int32()), pa.array(n[at], pa.int32())],
                names=["gram", "toxic", "n"])
    return run


def _log_ratio_bound(n1: Column, n0: Column, t1: float, t0: float) -> Column:
    """Lower confidence bound of log(P(gram | toxic) / P(gram | other))."""
    a, b = (n1 + 0.5) / (t1 + 1), (n0 + 0.5) / (t0 + 1)
    spread = F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    return F.log(a / b) - 1.645 * spread


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    xb = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(xb.shape[1])
    pen = np.full(xb.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        g = xb.T @ (p - y) / len(y) + pen * w
        h = (xb * (p * (1 - p))[:, None]).T @ xb / len(y) + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What the tasks need to score: character model, n-gram weights, regression."""

    def __init__(self, lm: list[float], weights: np.ndarray, coef: np.ndarray):
        self.lm, self.weights, self.coef = lm, weights, coef


def train(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on the documents of ``labels``; the character model reads all ``docs``.

    At most ``fit_rows`` ids of each class are used, those of the lowest id
    hash, so the sample that is joined to the documents has a fixed bound.
    The intercept is set back to the share of the classes among all labels.
    """
    lm = language_model(count_language_model(docs, text_col))
    one = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    order = [F.xxhash64("id"), F.col("id")]
    sample = (one.where("y = 1").orderBy(*order).limit(fit_rows)
              .unionAll(one.where("y = 0").orderBy(*order).limit(fit_rows)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = written(texts.join(F.broadcast(sample), "id"), "toxicity-sample")
    everyone = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    fit_part = F.pmod(F.shiftright(F.xxhash64("id"), 8), F.lit(3))
    counted = {r["y"]: r["n"] for r in rows.where(fit_part > 0).groupBy("y").agg(F.count("*").alias("n")).collect()}
    t1, t0 = counted.get(1, 0), counted.get(0, 0)
    grams = rows.where(fit_part > 0).select("t", "y").mapInArrow(lean(_gram_counts(lm)), "gram int, toxic int, n int")
    n1 = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    n0 = F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    kept = (grams.groupBy("gram").agg(n1.alias("n1"), n0.alias("n0")).where("n1 >= 2")
            .withColumn("w", _log_ratio_bound(F.col("n1"), F.col("n0"), t1, t0)).where("w > 0")
            .select("gram", "w").toPandas())
    weights = np.zeros(1 << GRAM_BITS, np.float32)
    weights[kept["gram"].to_numpy(int)] = kept["w"].to_numpy()
    bc = docs.sparkSession.sparkContext.broadcast(Model(lm, weights, np.zeros(N_FEATURES + 1)))
    cols = ", ".join(f"f{k} double" for k in range(N_FEATURES))
    feats = rows.where(fit_part == 0).select("t", "y").mapInArrow(lean(_featurize(bc)), f"y int, {cols}").toPandas()
    y = feats["y"].to_numpy(float)
    prior = math.log((everyone.get(1, 0) + 0.5) / (everyone.get(0, 0) + 0.5))
    coef = np.zeros(N_FEATURES + 1)
    coef[-1] = prior
    if len(y) and 0 < y.sum() < len(y):
        coef = logistic(feats[[f"f{k}" for k in range(N_FEATURES)]].to_numpy(), y)
        coef[-1] += prior - math.log(y.sum() / (len(y) - y.sum()))
    return Model(lm, weights, coef)


def _featurize(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = WordWeights(model.lm, model.weights)
        for batch in batches:
            f = np.array([words.features(x.as_py()) for x in batch.column(0)], float).reshape(-1, N_FEATURES)
            cols = [batch.column(1), *(pa.array(f[:, k]) for k in range(N_FEATURES))]
            yield pa.RecordBatch.from_arrays(cols, names=["y", *(f"f{k}" for k in range(N_FEATURES))])
    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` with the toxicity score of every whole text."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(out_col, "double")
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    src = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("text__")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        words = WordWeights(m.lm, m.weights)
        for batch in batches:
            f = np.array([words.features(x.as_py()) for x in batch.column(text_at)], float).reshape(-1, N_FEATURES)
            z = np.clip(f @ m.coef[:-1] + m.coef[-1], -30, 30)
            cols = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-z)))], names=[*keep, out_col])

    return src.mapInArrow(lean(run), schema)
