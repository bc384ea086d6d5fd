"""Toxicity: a linear-chain conditional random field tags toxic words.

The words of a text are a chain of labels, 0 clean and 1 toxic. A word's evidence is a sum of weights: of the
word, of its first four, five and six bytes, of the word before and of the word after it. Neighbouring labels have
weights of their own. Features are hashed into tables of fixed size, so none is chosen or cut by its frequency.

Labels are per document, so those of words are latent: a document labelled 0 has only zeros, one labelled 1
has at least one 1 somewhere. Training maximises the likelihood of just that. With Z the sum over all label
sequences (that of zeros alone counts 1) a clean document has the likelihood 1 / Z, a toxic one 1 - 1 / Z, and the
gradient is the marginals of forward-backward times -1 or 1 / (Z - 1): once something in a toxic text explains its label,
its other words learn no more.

A document's score is a logistic function of the log of Z - 1 and the sum of the marginals, fitted on training rows that the
field has not seen; its offending offsets are the runs of words at 0.5 or more. Forward and backward messages run over the whole text, in
chunks whose transfer matrices are multiplied side by side and joined in order.

Fitting reads at most ``SAMPLE`` labelled rows (least hash of the id first, half of them toxic where there are
so many) of together at most ``SAMPLE_WORDS`` words; a row that alone has more words than are left is passed over. Scoring is one pass
without a shuffle and uses the text alone.

Defined results: null and empty texts get the score of a text without evidence; repeated rows get
equal scores; without training rows of both labels every score is the share of toxic rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textkit import _FOLD, PIECE, Piece, _power, mix64, pieces
from lumenlake.plans.ship import ship

SAMPLE, SAMPLE_WORDS = 20_000, 2_000_000
PREFIXES = (4, 5, 6)
#: Slots of the tables: the word, its beginnings, the word before, the word after.
BITS = (20, 18, 18, 18, 16, 16)
CHUNK = 32
EPOCHS, BATCH_WORDS, RATE, DECAY, BIAS, CALIBRATE = 4, 100_000, 0.5, 0.01, -6.0, 5
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def word_hashes(p: Piece) -> np.ndarray:
    """Hashes of each word and its beginnings, without ASCII punctuation around it and A-Z as a-z: words x 4; 0 where a word is too short."""
    s, e = p.start.copy(), p.end.copy()
    for _ in range(3):
        s += (e - s > 1) & _PUNCT[p.data[s]]
        e -= (e - s > 1) & _PUNCT[p.data[e - 1]]
    out, i, n = np.zeros((1 + len(PREFIXES), len(s)), np.uint64), 0, len(s)
    while i < n:
        j = max(i + 1, int(np.searchsorted(p.start, p.start[i] + PIECE)))
        lo, hi = int(p.start[i]), int(p.end[j - 1])
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_FOLD[p.data[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[0, i:j] = mix64((sums[b] - sums[a]) * down[a])
        for k, w in enumerate(PREFIXES):
            long = b - a >= w
            out[k + 1, i:j] = np.where(long, mix64((sums[np.minimum(a + w, b)] - sums[a]) * down[a] + np.uint64(w)), 0)
        i = j
    return out


def features(p: Piece) -> np.ndarray:
    """Slots of the six features of each word (features x words); slot 0 is none."""
    h = word_hashes(p)
    out = np.zeros((len(BITS), h.shape[1]), np.int32)
    for k, bits in enumerate(BITS[:4]):
        out[k] = h[k] & np.uint64((1 << bits) - 1)
    word = (h[0] >> np.uint64(40)) & np.uint64((1 << BITS[4]) - 1)
    out[4, 1:], out[5, :-1] = word[:-1], word[1:]
    some = p.word_at[1:] > p.word_at[:-1]
    out[4, p.word_at[:-1][some]] = 0
    out[5, p.word_at[1:][some] - 1] = 0
    return out


@dataclass
class Chain:
    """Forward-backward over texts of words, cut into chunks; the results are those of whole texts.

    ``size`` words of each text stand one after the other. Label 1 of a word weighs ``exp(score)``; ``edge``
    holds the log weights of 0-1, 1-0 and 1-1. What stands before a text counts as label 0.
    """

    size: np.ndarray
    edge: np.ndarray
    first: np.ndarray = field(init=False)  # of each chunk the first word
    text: np.ndarray = field(init=False)  # and its text
    inside: np.ndarray = field(init=False)  # places x chunks

    def __post_init__(self) -> None:
        chunks = -(-self.size // CHUNK)
        self.at = np.cumsum(chunks) - chunks  # of each text the first chunk
        self.chunks = chunks
        self.text = np.repeat(np.arange(len(self.size)), chunks)
        nth = np.arange(len(self.text)) - self.at[self.text]
        word = np.cumsum(self.size) - self.size
        self.first = word[self.text] + CHUNK * nth
        self.word = self.first + np.arange(CHUNK)[:, None]
        self.inside = self.word < (word + self.size)[self.text]
        self.e = np.exp(self.edge)
        # Chunks by their number in their text: those are joined side by side.
        order = np.argsort(nth, kind="stable")
        self.ranks = np.split(order, np.flatnonzero(np.diff(nth[order])) + 1) if len(order) else []

    def run(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of words, log Z of texts, and of chunks the expected 0-1, 1-0 and 1-1 (3 x chunks)."""
        e01, e10, e11 = self.e
        k = len(self.text)
        node = np.where(self.inside, np.exp(np.clip(score, -30, 15))[np.minimum(self.word, max(0, len(score) - 1))] if len(score) else 1.0, 1.0)
        # Transfer matrix of each chunk: rows are the label before it, columns its last label.
        a, b, c, d = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
        scale = np.zeros(k)
        for t in range(CHUNK):
            on, n = self.inside[t], node[t]
            a, b = np.where(on, a + b * e10, a), np.where(on, (a * e01 + b * e11) * n, b)
            c, d = np.where(on, c + d * e10, c), np.where(on, (c * e01 + d * e11) * n, d)
            if t % 8 == 7:
                top = np.maximum(np.maximum(a, b), np.maximum(c, d))
                a, b, c, d, scale = a / top, b / top, c / top, d / top, scale + np.log(top)
        # Messages into each chunk from before and from behind.
        f0, f1, g0, g1 = np.ones(k), np.zeros(k), np.ones(k), np.ones(k)
        log_z = np.zeros(len(self.size))
        for rank in self.ranks:
            x, y = f0[rank], f1[rank]
            u, v = x * a[rank] + y * c[rank], x * b[rank] + y * d[rank]
            s = u + v
            log_z[self.text[rank]] += np.log(s) + scale[rank]
            on = rank + 1
            go = (on < k) & (self.text[np.minimum(on, k - 1)] == self.text[rank])
            f0[on[go]], f1[on[go]] = (u / s)[go], (v / s)[go]
        for rank in reversed(self.ranks):
            x, y = g0[rank], g1[rank]
            u, v = a[rank] * x + b[rank] * y, c[rank] * x + d[rank] * y
            s = u + v
            go = (rank > 0) & (self.text[rank - 1] == self.text[rank])
            g0[rank[go] - 1], g1[rank[go] - 1] = (u / s)[go], (v / s)[go]
        x0, x1 = f0, f1
        before, alpha = np.empty((CHUNK, 2, k)), np.empty((CHUNK, 2, k))
        for t in range(CHUNK):
            before[t] = x0, x1
            u, v = x0 + x1 * e10, (x0 * e01 + x1 * e11) * node[t]
            s, on = u + v, self.inside[t]
            x0, x1 = np.where(on, u / s, x0), np.where(on, v / s, x1)
            alpha[t] = x0, x1
        out, pair = np.empty(len(score)), np.zeros((3, k))
        y0, y1 = g0, g1
        for t in range(CHUNK - 1, -1, -1):
            on, n = self.inside[t], node[t]
            u, v = alpha[t, 0] * y0, alpha[t, 1] * y1
            out[self.word[t, on]] = (v / (u + v))[on]
            p0, p1 = before[t]
            w01, w10, w11 = p0 * e01 * n * y1, p1 * e10 * y0, p1 * e11 * n * y1
            total = p0 * y0 + w01 + w10 + w11
            pair += np.where(on, np.stack([w01, w10, w11]) / total, 0)
            z0, z1 = y0 + e01 * n * y1, e10 * y0 + e11 * n * y1
            s = z0 + z1
            y0, y1 = np.where(on, z0 / s, y0), np.where(on, z1 / s, y1)
        return out, log_z, pair


@dataclass
class Tagger:
    tables: list[np.ndarray]  # weights by slot
    bias: float
    edge: np.ndarray
    doc: np.ndarray  # logistic: constant, log of Z - 1, log of the sum of marginals

    @staticmethod
    def blank(share: float = 0.0) -> Tagger:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Tagger([np.zeros(1 << b, np.float32) for b in BITS], BIAS, np.zeros(3), np.array([np.log(p / (1 - p)), 0, 0]))

    def evidence(self, slots: np.ndarray) -> np.ndarray:
        out = np.full(slots.shape[1], self.bias)
        for table, s in zip(self.tables, slots):
            out += table[s]
        return out

    def tag(self, slots: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of words, and scores of texts."""
        p, log_z, _ = Chain(size, self.edge).run(self.evidence(slots))
        return p, self.score(log_z, sums(p, size))

    def score(self, log_z: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregate(log_z, total) @ self.doc, -30, 30)))


def sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over texts."""
    upto = np.concatenate([[0], np.cumsum(x)])
    end = np.cumsum(size)
    return np.maximum(upto[end] - upto[end - size], 0)


def aggregate(log_z: np.ndarray, total: np.ndarray) -> np.ndarray:
    odds = np.where(log_z > 30, log_z, np.log(np.maximum(np.expm1(np.minimum(log_z, 30)), 1e-7)))
    return np.stack([np.ones(len(odds)), np.clip(odds, -10, 20) / 4, np.log1p(total)], 1)


def train(slots: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> Tagger:
    """Likelihood of the documents' labels, climbed in batches of texts with a step for each feature by how often it occurs.

    Weights start at the log of how much commoner a feature is in toxic texts, shrunk where it is rare.
    """
    tagger = Tagger.blank()
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(size)), size)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    counts = []
    for k, table in enumerate(tagger.tables):
        once = np.unique(slots[k].astype(np.int64) * len(size) + doc)
        slot, of = once // len(size), toxic[once % len(size)]
        c1, c0 = (np.bincount(slot[x], minlength=len(table)) for x in (of, ~of))
        sure = (c1 + c0) / (c1 + c0 + 20)
        gain = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        table[:] = np.clip(np.where(c1 + c0 > 0, gain * sure, 0), -4, 4) * (0.5 if k < 4 else 0)
        table[0] = 0
        counts.append(np.bincount(slots[k], minlength=len(table)))
    batches, held = [[]], 0
    for i in np.random.default_rng(3).permutation(len(size)).tolist():
        if held + size[i] > BATCH_WORDS and held:
            batches.append([])
            held = 0
        batches[-1].append(i)
        held += int(size[i])
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 4)
        for batch in batches:
            docs = np.array(batch)
            n = size[docs]
            words = np.repeat(end[docs] - n, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            mine = slots[:, words]
            chain = Chain(n, tagger.edge)
            p, log_z, pair = chain.run(tagger.evidence(mine))
            pull = np.where(toxic[docs], 1 / np.maximum(np.expm1(np.minimum(log_z, 50)), 0.02), -1.0)
            grad = p * np.repeat(pull, n)
            for k, table in enumerate(tagger.tables):
                slot, at = np.unique(mine[k], return_inverse=True)
                g, seen = np.bincount(at, grad), np.bincount(at)
                # Of a feature seen n times in all a full step is its mean pull; rare ones move less.
                step = rate * (g / (0.02 * seen + 3) - DECAY * table[slot] * seen / counts[k][slot])
                table[slot] = np.clip(table[slot] + step, -6, 6)
                table[0] = 0
            tagger.bias = float(np.clip(tagger.bias + rate * grad.sum() / (0.02 * len(grad) + 3), -9, -3))
            tagger.edge = np.clip(tagger.edge + rate * (pair * pull[chain.text]).sum(1) / (0.05 * len(docs) * 5 + 10), -2, 2)
    return tagger


def calibrate(tagger: Tagger, log_z: np.ndarray, total: np.ndarray, toxic: np.ndarray) -> Tagger:
    """Logistic regression of document labels, by Newton steps with a small ridge."""
    x, w, ridge = aggregate(log_z, total), np.zeros(3), np.array([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(h, x.T @ (toxic - p) - ridge * w)
    tagger.doc = w
    return tagger


def learn(slots: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> Tagger:
    """A field from some of the texts, and its scores calibrated on the others."""
    if toxic.all() or not toxic.any():
        return Tagger.blank(float(toxic.mean()) if len(toxic) else 0.0)
    # Every CALIBRATE-th text of each label is kept for calibration, unless there are too few.
    nth = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic))
    other = nth % CALIBRATE == 0
    if toxic[other].sum() < 3 or (~toxic[other]).sum() < 3:
        other[:] = False
    some = np.repeat(~other, size)
    tagger = train(slots[:, some], size[~other], toxic[~other])
    use = other if other.any() else ~other
    words = np.repeat(use, size)
    p, log_z, _ = Chain(size[use], tagger.edge).run(tagger.evidence(slots[:, words]))
    return calibrate(tagger, log_z, sums(p, size[use]), toxic[use].astype(float))


def fit(
    docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS
) -> Tagger:
    """A tagger from labelled rows where ``train_on`` (over ``labels``) holds: at most ``sample`` rows and ``sample_words`` words, which are all that reaches the driver."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(train_on & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("label_"))
    first = lambda label, n: known.where(F.col("label_") == label).orderBy(F.xxhash64("id_"), "id_").limit(n)
    few = first(1, sample // 2)
    some = few.union(first(0, sample - few.count()))
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).join(F.broadcast(some), "id_")
    # Rows that repeat an id with its text are one.
    rows = rows.withColumn("key_", F.xxhash64("id_", "text_"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [x for p in pieces(batch.column(2)) for x in p.words_in().tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["key_", "label_", "n"])

    sizes = rows.select("key_", "label_", "text_").mapInArrow(count, "key_ long, label_ int, n long").groupBy("key_", "label_").agg(F.max("n").alias("n"))
    chosen, left = [], {1: sample_words // 2, 0: sample_words}
    for label in (1, 0):
        for r in sizes.where(F.col("label_") == label).orderBy(F.xxhash64("key_"), "key_").limit(sample).collect():
            if r["n"] <= left[label]:
                left[label] -= r["n"]
                chosen.append((r["key_"], label))
        left[0] -= sample_words // 2 - left[1] if label else 0
    wanted = F.broadcast(spark.createDataFrame(chosen, "key_ long, label_ int"))
    got = rows.join(wanted, ["key_", "label_"]).groupBy("key_", "label_").agg(F.first("text_").alias("text_")).orderBy(F.xxhash64("key_"), "key_", "label_").toArrow()
    slots, size = [np.zeros((len(BITS), 0), np.int32)], [np.zeros(0, np.int64)]
    for chunk in got["text_"].chunks:
        for p in pieces(chunk):
            slots.append(features(p)), size.append(p.words_in())
    return learn(np.concatenate(slots, 1), np.concatenate(size), got["label_"].to_numpy() == 1)


SCORED = "struct<score:double,spans:array<struct<start:int,end:int,p:double>>>"


def scorer(sent: object):
    """An Arrow UDF from text to SCORED by a broadcast tagger; offsets are in code points, end exclusive."""

    @F.arrow_udf(SCORED)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = sent.value
        for texts in batches:
            scores, count, parts = [np.empty(0)], [np.zeros(0, np.int64)], [np.empty((3, 0))]
            for p in pieces(texts):
                m, own = tagger.tag(features(p), p.words_in())
                scores.append(own)
                hot = np.flatnonzero(m >= 0.5)
                text = np.searchsorted(p.word_at, hot, "right") - 1
                new = np.flatnonzero((np.diff(hot, prepend=-2) > 1) | (np.diff(text, prepend=-1) > 0))
                last = np.append(new[1:], len(hot)) - 1 if len(new) else new
                chars = np.concatenate([[0], np.cumsum((p.data & 0xC0) != 0x80)])
                base = chars[p.offsets[text[new]]]
                top = np.maximum.reduceat(m[hot], new) if len(new) else np.empty(0)
                parts.append(np.stack([chars[p.start[hot[new]]] - base, chars[p.end[hot[last]]] - base, top]))
                count.append(np.bincount(text[new], minlength=len(p)))
            start, end, top = np.concatenate(parts, 1)
            struct = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(top)], ["start", "end", "p"])
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(count))]), pa.int32())
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.ListArray.from_arrays(bounds, struct)], ["score", "spans"])

    return score


def score_toxicity(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``spans`` array<struct<start,end,p>> of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    sent = spark.sparkContext.broadcast(tagger)  # tables of fixed size, about 8 MB
    return rows.select(F.col("id_").alias(id_col), scorer(sent)("text_").alias("v")).select(id_col, "v.*")
