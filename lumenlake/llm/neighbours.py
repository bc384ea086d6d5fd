"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is three bags of hashed features: its words (A-Z as a-z), the shapes of its words and of pairs of
neighbours (runs of capitals, small letters, digits and each punctuation mark, so ``word###`` and ``word!!`` differ from ``word,``), and
how its words recur (equal to the word before, to one of the last few, a word that a window of words has again and again). Counts
are damped by the logarithm, weighted by the inverse document frequency, and each bag is scaled to length one, so that a long bag
does not drown a short one. A truncated singular value decomposition of the labelled sample (randomised range
finder, power iterations) gives the latent directions.

The labelled vectors, of length one, are sent to all tasks: at most ``SAMPLE`` rows of ``RANK`` floats. Every document is
projected, its cosines with all labelled vectors come from a matrix product for each block of documents, exactly, without an
index that might miss one, and each neighbour votes for its label with the weight ``exp(SHARP * (cosine - nearest cosine))``. Labels of either kind
weigh alike in all. The share of the votes for 1, moved by a threshold that labelled rows set on each other (a row never votes for itself), is the score.

Fitting reads at most ``SAMPLE`` labelled rows, half of them of each label where there are so many, those with the least hash of their
id, of together at most ``SAMPLE_WORDS`` words; a row that alone has more than are left is passed over. Scoring is one pass without
a shuffle and reads the text alone.

Defined results: null and empty texts have no features; their score is the share of such a text's votes, which is that of cosines of
0 (empty training texts are left out), so the labels' prior, 0.5, moved as the others are. Repeated rows and ties of cosine need no
order, as all neighbours vote. Very long texts are taken whole. Without training rows of both labels every score is the
share of rows labelled 1 (0.5 without any). An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textkit import Piece, column, mix64, pieces
from lumenlake.plans.ship import ship

SAMPLE, SAMPLE_WORDS, RANK, SHARP = 4_000, 2_000_000, 64, 24.0
#: Slots of the bags of words, shapes and recurrences.
SLOTS = (1 << 15, 1 << 13, 1 << 10)
TOTAL = sum(SLOTS)
#: Documents of a block of cosines.
BLOCK = 512
_KIND = np.zeros(256, np.uint64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if "a" <= _c <= "z" or _b >= 128 else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else _b + 4


def shapes(p: Piece) -> np.ndarray:
    """A hash of each word's shape: its runs of kinds of bytes, runs of punctuation with their length."""
    kind = _KIND[p.data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[p.start] = True
    counted = first | (kind > 3)  # letters and digits count once a run, marks one by one
    at = np.flatnonzero(counted)
    value = kind[at]
    lo, hi = np.searchsorted(at, p.start), np.searchsorted(at, p.end)
    out = np.zeros(len(p.start), np.uint64)
    size = hi - lo
    for k in range(int(min(size.max(initial=0), 8))):  # shapes are told apart by eight places and their length
        has = size > k
        out[has] = mix64(out[has] * np.uint64(31) + value[lo[has] + k] + np.uint64(1))
    return mix64(out + np.minimum(size, 16).astype(np.uint64))


def features(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text's features, sparse: text, slot, count."""
    h, s = p.hashes(fold=True), shapes(p)
    text = np.repeat(np.arange(len(p)), p.words_in())
    n = len(h)
    pair = np.zeros(n, np.uint64)
    pair[1:] = mix64(s[:-1] * np.uint64(3) + s[1:])
    within = np.zeros(n, bool)
    within[1:] = text[1:] == text[:-1]
    again = np.zeros(n, np.uint64)  # distance to the same word among the last eight, 0: none
    for back in range(8, 0, -1):
        same = np.zeros(n, bool)
        same[back:] = (h[back:] == h[:-back]) & (text[back:] == text[:-back])
        again[same] = back
    length = np.minimum(p.end - p.start, 24).astype(np.uint64)
    a, b, c = (np.uint64(x) for x in SLOTS)
    slot = np.concatenate([h % a, a + s % b, (a + pair % b)[within], a + b + mix64(again + np.uint64(1)) % c, a + b + mix64(length + np.uint64(100)) % c]).astype(np.int64)
    key, count = np.unique(np.concatenate([text, text, text[within], text, text]) * TOTAL + slot, return_counts=True)
    return key // TOTAL, key % TOTAL, count


@dataclass
class Weighted:
    """Sparse rows, each bag of each row of length one."""

    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    rows: int

    @staticmethod
    def of(row: np.ndarray, slot: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray) -> Weighted:
        value = (1 + np.log(count)) * idf[slot]
        bag = row * len(SLOTS) + np.searchsorted(np.cumsum(SLOTS), slot, side="right")
        norm = np.sqrt(np.bincount(bag, value**2, minlength=rows * len(SLOTS)))[bag]
        return Weighted(row, slot, np.divide(value, norm, out=np.zeros_like(value), where=norm > 0).astype(np.float32), rows)

    def times(self, dense: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """This by a dense matrix (slots x columns); rows are in order."""
        out = np.zeros((self.rows, dense.shape[1]), np.float32)
        for i in range(0, len(self.row), step):
            row = self.row[i : i + step]
            at = np.flatnonzero(np.diff(row, prepend=-1))
            part = dense[self.slot[i : i + step]]
            part *= self.value[i : i + step, None]
            out[row[at]] += np.add.reduceat(part, at, axis=0)
        return out

    def transposed(self) -> Weighted:
        order = np.argsort(self.slot, kind="stable")
        return Weighted(self.slot[order], self.row[order], self.value[order], TOTAL)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


@dataclass
class Neighbours:
    """``basis``: slots x rank; ``vectors``: labelled rows x rank of length one; ``share``: the score without both labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    threshold: float = 0.5
    share: float = 0.5

    def project(self, p: Piece) -> np.ndarray:
        return unit(Weighted.of(*features(p), len(p), self.idf).times(self.basis))

    def votes(self, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Share of the votes for label 1; ``own``: the labelled row that each row is, which does not vote for it."""
        out = np.empty(len(x))
        good = self.label == 1
        for i in range(0, len(x), BLOCK):
            cosine = x[i : i + BLOCK] @ self.vectors.T
            if own is not None:
                cosine[np.arange(len(cosine)), own[i : i + BLOCK]] = -np.inf
            w = np.exp(SHARP * (cosine - cosine.max(1, keepdims=True)))
            one, two = w[:, good].sum(1, dtype=float) / good.sum(), w[:, ~good].sum(1, dtype=float) / (~good).sum()
            out[i : i + BLOCK] = one / (one + two)
        return out

    def score(self, p: Piece) -> np.ndarray:
        if not len(self.label):
            return np.full(len(p), self.share)
        return moved(self.votes(self.project(p)), self.threshold)


def moved(share: np.ndarray, threshold: float) -> np.ndarray:
    """Shares with the threshold moved to 0.5: order is kept, 0 and 1 stay."""
    return np.clip(np.where(share < threshold, share / (2 * threshold), 1 - (1 - share) / (2 * (1 - threshold))), 0, 1)


def decompose(a: Weighted, rank: int) -> np.ndarray:
    """The leading right singular vectors (slots x rank) by a randomised range finder."""
    back = a.transposed()
    q = np.random.default_rng(11).standard_normal((TOTAL, rank + 16)).astype(np.float32)
    for _ in range(3):
        y, _ = np.linalg.qr(a.times(q))
        q, _ = np.linalg.qr(back.times(y.astype(np.float32)))
    _, _, v = np.linalg.svd(a.times(q.astype(np.float32)), full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank].astype(np.float32))


def best_threshold(share: np.ndarray, label: np.ndarray) -> float:
    """Where the mean of the two labels' accuracies is highest; the middle between neighbouring shares."""
    order = np.argsort(share, kind="stable")
    s, y = share[order], label[order] == 1
    right = np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum()) + (y.sum() - np.concatenate([[0], np.cumsum(y)])) / max(1, y.sum())
    edge = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    right[1:-1][s[1:] == s[:-1]] = -1
    return float(np.clip(edge[np.argmax(right)], 0.02, 0.98))


def train(texts: list[str], label: np.ndarray) -> Neighbours:
    """The space, the labelled vectors and the threshold; texts without words are left out."""
    share = float(label.mean()) if len(label) else 0.5
    row, slot, count, kept, n = [], [], [], [], 0
    for p in pieces(pa.array(texts, pa.large_string())):
        a, b, c = features(p)
        have, a = np.unique(a, return_inverse=True)
        row, slot, count = [*row, a + n], [*slot, b], [*count, c]
        kept.append(have + p.first)
        n += len(have)
    label = label[np.concatenate(kept)] if n else label[:0]
    if len(np.unique(label)) < 2:
        return Neighbours(*(np.empty((0, 0), np.float32),) * 3, np.empty(0, np.int64), share=share)
    row, slot, count = np.concatenate(row), np.concatenate(slot), np.concatenate(count)
    idf = np.log((1 + n) / (1 + np.bincount(slot, minlength=TOTAL))) + 0.1
    a = Weighted.of(row, slot, count, n, idf)
    basis = decompose(a, min(RANK, n))
    model = Neighbours(idf, basis, unit(a.times(basis)), label)
    model.threshold = best_threshold(model.votes(model.vectors, np.arange(n)), label)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Neighbours:
    """Train on labelled documents for which ``usable``, a condition on ``doc_id``, holds."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), (usable if usable is not None else F.lit(True)).alias("use"))
    known = known.where("use").groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit("neighbours"), "id")
    halves = [known.where(F.col("y") == y).orderBy(order, "id").limit(SAMPLE) for y in (0, 1)]
    picked = sorted((r for half in halves for r in half.collect()), key=lambda r: r["y"])
    zeros = [r for r in picked if r["y"] == 0]
    ones = picked[len(zeros) :]
    few = SAMPLE - min(len(zeros), len(ones), SAMPLE // 2)
    chosen = {r["id"]: r["y"] for r in [*zeros[: few if len(zeros) > len(ones) else SAMPLE // 2], *ones[: few if len(ones) >= len(zeros) else SAMPLE // 2]]}
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"id {dict(known.dtypes)['id']}")
    words = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "id")
    sized = rows.groupBy("id").agg(F.min(F.struct(words.alias("n"), F.col("text"))).alias("t")).select("id", "t.n", "t.text")
    return _train_within(sized, chosen, order)


def _train_within(sized: DataFrame, chosen: dict, order: Column) -> Neighbours:
    sizes = {r["id"]: r["n"] for r in sized.select("id", "n").orderBy(order, "id").collect()}
    left, kept = SAMPLE_WORDS, []
    turn = [[i for i in sizes if chosen[i] == y] for y in (0, 1)]
    for pair in range(max(map(len, turn), default=0)):  # the labels take turns, so that neither uses up the words
        for side in turn:
            if pair < len(side) and sizes[side[pair]] <= left:
                left -= sizes[side[pair]]
                kept.append(side[pair])
    spark = sized.sparkSession
    ids = spark.createDataFrame([(i,) for i in kept], f"id {dict(sized.dtypes)['id']}")
    got = {r["id"]: r["text"] for r in sized.join(F.broadcast(ids), "id").select("id", "text").collect()}
    kept = [i for i in kept if i in got]
    return train([got[i] for i in kept], np.array([chosen[i] for i in kept], np.int64))


def score_quality(docs: DataFrame, model: Neighbours, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every document: 0 to 1, higher is likelier to be of label 1."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(p) for p in pieces(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(np.concatenate(out) if out else np.empty(0))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
