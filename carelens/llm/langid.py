"""Language identification by segmentation-marginalised unigrams.

Each language is a unigram model over the pieces of a fixed public
vocabulary. A word (marked at its start as that vocabulary marks words) has
many segmentations into pieces; its probability is the sum over all of
them, computed by the forward algorithm. A text's log-likelihood under a
language is the sum over its words.

Training gathers expected piece counts over every training document (EM):
each task counts its word types per language, weighs every segmentation of
a type by its probability under the current pieces, and adds up the
posterior piece counts; tasks' counts meet in one aggregation of at most
pieces x languages cells. The first round starts from equal pieces, and by
default it is the only one: further rounds weigh segmentations by each
language's own pieces, read all training documents again, and do not change
the held-out accuracy (see this folder's README).

Edge cases: NULL text, or text without a letter, is ``und`` with score 0;
words of any length are summed whole (above ``SHORT_WORD`` characters with
logarithms, one place after the other); a character in no piece has a fixed small probability; training rows
need a non-NULL language; with no training row every text is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import lean

UNDETERMINED = "und"
MARK = "▁"  # word start in the vocabulary
SHORT_WORD = 30  # words up to this length are summed in groups of one length; longer ones by logarithms
UNSEEN = 1e-9
SMOOTHING = 0.1
CACHE_WORDS = 200_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """Pieces of a sentencepiece model file; control and byte pieces left out."""
    import sentencepiece as spm
    sp = spm.SentencePieceProcessor(model_file=path)
    return tuple(
        sp.id_to_piece(i) for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    )


def words(text: str) -> list[str]:
    return text.lower().split()


class PieceTable:
    """Piece ids by a hash of their characters, looked up for whole arrays.

    Open addressing on the hash that :func:`extend` builds character by
    character, so the spans that start at one place share their work.
    """

    def __init__(self, pieces: tuple[str, ...]):
        self.longest = max(map(len, pieces), default=1)
        self.bits = max(8, (16 * len(pieces)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int64)
        hashes = np.zeros(len(pieces), np.uint64)
        by_len: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_len.setdefault(len(p), []).append(k)
        for n, ks in by_len.items():
            text = "".join([pieces[k] for k in ks]).encode("utf-32-le", "surrogatepass")
            h = np.zeros(len(ks), np.uint64)
            for ch in np.frombuffer(text, np.uint32).reshape(-1, n).T.astype(np.uint64):
                h = self.extend(h, ch)
            hashes[ks] = h
        taken: dict[int, int] = {}
        for k, slot in enumerate(self._slot(hashes).tolist()):
            while slot in taken:
                slot = (slot + 1) & (len(self.keys) - 1)
            taken[slot] = k
        slots = np.array(list(taken), np.int64)
        self.values[slots] = list(taken.values())
        self.keys[slots] = hashes[self.values[slots]]

    @staticmethod
    def extend(h: np.ndarray, ch: np.ndarray) -> np.ndarray:
        h = (h ^ (ch + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is that of a piece, and the piece of each."""
        slot = self._slot(h)
        rows, found, ids = np.arange(len(h)), [], []
        while len(rows):
            key = self.keys[slot]
            same = key == h[rows]
            found.append(rows[same])
            ids.append(self.values[slot[same]])
            more = (key != 0) & ~same
            rows, slot = rows[more], (slot[more] + 1) & (len(self.keys) - 1)
        return np.concatenate(found), np.concatenate(ids)


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(vocabulary(path))


class Lattice:
    """Forward and backward sums over all segmentations, by word length.

    ``probs`` is pieces x models; a last row holds the unseen character.
    """

    def __init__(self, pieces: PieceTable, probs: np.ndarray):
        self.pieces, self.probs = pieces, probs
        self.unseen = len(probs) - 1

    def groups(self, types: list[str]):
        """Types of one length together, and per span the rows and pieces that fit."""
        by_len: dict[int, list[int]] = {}
        for k, w in enumerate(types):
            by_len.setdefault(len(w), []).append(k)
        for n, ks in by_len.items():
            text = "".join([types[k] for k in ks]).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(text, np.uint32).reshape(-1, n).T.astype(np.uint64)
            spans = []
            for i in range(n):
                h = np.zeros(len(ks), np.uint64)
                for j in range(i + 1, min(n, i + self.pieces.longest) + 1):
                    h = self.pieces.extend(h, codes[j - 1])
                    rows, ids = self.pieces.find(h)
                    if j == i + 1 and len(rows) < len(ks):
                        rest = np.setdiff1d(np.arange(len(ks)), rows, assume_unique=True)
                        rows, ids = np.concatenate([rows, rest]), np.concatenate([ids, np.full(len(rest), self.unseen)])
                    if len(rows):
                        spans.append((i, j, rows, ids))
            yield np.array(ks, np.int64), n, spans

    def _forward(self, n: int, spans, m: int) -> list[np.ndarray]:
        alpha = [np.zeros((m, self.probs.shape[1])) for _ in range(n + 1)]
        alpha[0][:] = 1.0
        for i, j, rows, ids in spans:
            alpha[j][rows] += alpha[i][rows] * self.probs[ids]
        return alpha

    def log_probs(self, types: list[str]) -> np.ndarray:
        """types x models: log of the sum over segmentations."""
        out = np.zeros((len(types), self.probs.shape[1]))
        short, long = _by_length(types)
        for ks, n, spans in self.groups([types[k] for k in short]):
            out[short[ks]] = np.log(self._forward(n, spans, len(ks))[-1])
        for k in long.tolist():
            out[k] = self.long_forward(self.span_ids(types[k]))[-1]
        return out

    def span_ids(self, word: str) -> np.ndarray:
        """places x span lengths: the piece that starts there with that length, -1 for none."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        out = np.full((n, min(n, self.pieces.longest)), -1, np.int32)
        h = np.zeros(n, np.uint64)
        for k in range(out.shape[1]):
            h = self.pieces.extend(h[:n - k], codes[k:])
            rows, ids = self.pieces.find(h)
            out[rows, k] = ids
        out[out[:, 0] < 0, 0] = self.unseen
        return out

    def long_forward(self, ids: np.ndarray) -> np.ndarray:
        """places + 1 x models: log sums over the segmentations of what lies before a place."""
        n, spans = ids.shape
        logs = np.log(self.probs)
        out = np.full((n + 1, self.probs.shape[1]), -np.inf)
        out[0] = 0.0
        place = np.arange(spans)
        for j in range(1, n + 1):
            k = place[:min(spans, j)]
            piece = ids[j - 1 - k, k]
            k, piece = k[piece >= 0], piece[piece >= 0]
            terms = out[j - 1 - k] + logs[piece]
            top = terms.max(axis=0)
            out[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return out

    def long_backward(self, ids: np.ndarray) -> np.ndarray:
        """places + 1 x models: log sums over the segmentations of what lies behind a place."""
        n, spans = ids.shape
        logs = np.log(self.probs)
        out = np.full((n + 1, self.probs.shape[1]), -np.inf)
        out[n] = 0.0
        for i in range(n - 1, -1, -1):
            k = np.flatnonzero(ids[i, :n - i] >= 0)
            terms = out[i + 1 + k] + logs[ids[i, k]]
            top = terms.max(axis=0)
            out[i] = top + np.log(np.exp(terms - top).sum(axis=0))
        return out

    def expected(self, types: list[str], counts: np.ndarray) -> np.ndarray:
        """Posterior piece counts, pieces x models, for counts types x models.

        Probabilities of one model are shared by all columns of ``counts``.
        """
        out = np.zeros((self.unseen + 1, counts.shape[1]))
        short, long = _by_length(types)
        for k in long.tolist():
            ids = self.span_ids(types[k])
            ahead, behind = self.long_forward(ids), self.long_backward(ids)
            at, length = np.nonzero(ids >= 0)
            piece = ids[at, length]
            post = np.exp(ahead[at] + np.log(self.probs)[piece] + behind[at + length + 1] - ahead[-1])
            for c in range(counts.shape[1]):
                out[:, c] += np.bincount(piece, post[:, c if post.shape[1] > 1 else 0], minlength=len(out)) * counts[k, c]
        counts = counts[short]
        for ks, n, spans in self.groups([types[k] for k in short]):
            alpha = self._forward(n, spans, len(ks))
            beta = [np.zeros_like(alpha[0]) for _ in range(n + 1)]
            beta[n][:] = 1.0
            for i, j, rows, ids in reversed(spans):
                beta[i][rows] += beta[j][rows] * self.probs[ids]
            scale = counts[ks] / alpha[n]
            pieces, posts = [], []
            for i, j, rows, ids in spans:
                pieces.append(ids)
                posts.append(alpha[i][rows] * self.probs[ids] * beta[j][rows] * scale[rows])
            piece, post = np.concatenate(pieces), np.concatenate(posts)
            for c in range(counts.shape[1]):
                out[:, c] += np.bincount(piece, post[:, c], minlength=len(out))
        return out


def _types(word_list) -> list[str]:
    return [MARK + w for w in word_list]


def _by_length(types: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the short words and of the long ones."""
    long = np.array([len(w) > SHORT_WORD for w in types], bool)
    return np.flatnonzero(~long), np.flatnonzero(long)


def train(
    docs: DataFrame,
    is_training: Column,
    vocab_path: str,
    rounds: int = 1,
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces + 1 unseen, languages).

    Every training document is read whole in every round. The languages
    are the distinct values of ``lang_col``; the model is vocabulary x
    languages cells, which is all that reaches the driver.
    """
    used = docs.where(is_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    pieces = vocabulary(vocab_path)
    shared = np.full((len(pieces) + 1, 1), 1.0 / (len(pieces) + 1))
    shared[-1] = UNSEEN
    langs: list[str] = []
    table = shared
    for _ in range(rounds):
        cells = used.mapInArrow(lean(_gather(vocab_path, langs, table)), "lang string, piece int, n double")
        got = cells.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        langs = sorted(got["lang"].unique())
        table = np.full((len(pieces) + 1, max(1, len(langs))), SMOOTHING)
        for k, lang in enumerate(langs):
            mine = got[got["lang"] == lang]
            np.add.at(table[:, k], mine["piece"].to_numpy(), mine["n"].to_numpy())
        table /= table.sum(axis=0, keepdims=True)
        table[-1] = np.maximum(table[-1], UNSEEN)
    return langs, table


def _gather(vocab_path: str, langs: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(piece_table(vocab_path), table)
        by_lang: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush():
            names = sorted(by_lang)
            if langs:  # a model per language: its own column each
                for lang in names:
                    own = Lattice(piece_table(vocab_path), table[:, [langs.index(lang)]])
                    ws = list(by_lang[lang])
                    n = np.array([[by_lang[lang][w]] for w in ws], float)
                    sums[lang] = sums.get(lang, 0) + own.expected(_types(ws), n)[:, 0]
            else:
                ws = list(set().union(*by_lang.values()))
                n = np.array([[by_lang[lang][w] for lang in names] for w in ws], float)
                for k, col in enumerate(lattice.expected(_types(ws), n).T):
                    sums[names[k]] = sums.get(names[k], 0) + col
            by_lang.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, Counter()).update(words(text.as_py()))
            if sum(map(len, by_lang.values())) > CACHE_WORDS:
                flush()
        if by_lang:
            flush()
        for lang, col in sums.items():
            ids = np.flatnonzero(col > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(col[ids])],
                names=["lang", "piece", "n"])
    return run


def predict(
    docs: DataFrame,
    langs: list[str],
    table: np.ndarray,
    vocab_path: str,
    keep: list[str],
    text_col: str = "text",
) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``.

    ``score`` is the posterior of the chosen language per square root of
    the text's words, so it stays informative on long texts.
    """
    src = docs.select(*keep, F.col(text_col).alias("text__"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    bc = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = bc.value
        lattice = Lattice(piece_table(vocab_path), table)
        row_of: dict[str, int] = {}
        rows = np.zeros((0, table.shape[1]))
        for batch in batches:
            if len(row_of) > CACHE_WORDS:
                row_of, rows = {}, rows[:0]
            texts = batch.column(len(keep))
            lists, new = [], set()
            for t in texts:
                t = t.as_py()
                ws = words(t) if t and any(map(str.isalpha, t)) else []
                lists.append(ws)
                new.update(ws)
            new = [w for w in new if w not in row_of]
            if new:
                for w in new:
                    row_of[w] = len(row_of)
                rows = np.concatenate([rows, lattice.log_probs(_types(new))])
            pred, score = [], []
            for ws in lists:
                if not ws or not langs:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                at = np.fromiter(map(row_of.__getitem__, ws), np.int64, len(ws))
                total = rows[at].sum(axis=0)
                k = int(total.argmax())
                p = np.exp((total - total[k]) / np.sqrt(len(ws)))
                pred.append(langs[k])
                score.append(float(1.0 / p.sum()))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(lean(run), schema)
