"""Quality rules: an isolation forest over rule statistics judges what the fixed rules pass.

Each text gets counts (words, symbols, repeated lines and words ...) and ratios of them. Random
splits isolate odd rows early, so a short mean path marks an anomaly. The main forest draws a random
statistic at each split of its trees, so it sees rows that are odd in a combination of statistics; the draw
favours statistics that rank labelled bad rows apart from good ones. A row that
is odd in one of them alone may be hidden by the others, so each statistic has a small forest of its own too.
Thresholds on the scores are calibrated from labelled rows, the main forest's first, then, best
first, while one catches more labelled bad rows; together they reject at most ``MAX_LOSS`` of the good ones.

Fitting reads every labelled row. How far a statistic ranks bad rows apart, and the thresholds, come from exact
counts over all of them: rows of (statistic or forest, value) are dealt by ranges of values, and sums within a range are
put after those of the ranges above. Only trees take few rows, as isolation needs it: each is grown over ``ROWS_PER_TREE``
rows drawn at random from all. Scoring is one pass over all rows without a shuffle.

Defined results: a null or empty text has no words and fails the base rules; repeated rows
get equal verdicts; without labelled rows of both kinds every row that passes the base
rules is kept; an empty table gives an empty result; other columns are ignored. Very long texts
are taken whole; rows of equal statistics have equal scores, and a score at a threshold is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lumenlake.llm import idfilter
from lumenlake.llm.store import Stage
from lumenlake.llm.textkit import Piece, grams, pieces
from lumenlake.plans.ship import ship

#: Trees of the main forest and of each statistic's, rows per tree, share of good rows that may be lost.
TREES, OWN_TREES, ROWS_PER_TREE, MAX_LOSS = 128, 32, 256, 0.002
#: Number of the main forest; those of single statistics have the statistic's.
MAIN = -1
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.int64)  # bit 0 symbol, 1 upper, 2 lower, 3 digit, 4 other ASCII punctuation
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b in SYMBOLS) | (_c.isascii() and _c.isupper()) << 1 | (_c.isascii() and _c.islower()) << 2 | (_c.isascii() and _c.isdigit()) << 3
    if 32 < _b < 127 and not _c.isalnum() and _b not in SYMBOLS:
        _CLASS[_b] |= 16
FEATURES = 13


def _again(x: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, which, times = np.unique(x, return_inverse=True, return_counts=True)
    return times[which] > 1


def statistics(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Of each text in a piece: STATS (ints) and the features of the forest (floats)."""
    n = len(p)
    head = (p.data & 0xC0) != 0x80  # first bytes of code points
    sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    chars, kinds = sums(head), [sums((_CLASS[p.data] >> k) & 1) for k in range(5)]
    in_text = lambda c: c[p.offsets[1:]] - c[p.offsets[:-1]]
    lengths = chars[p.end] - chars[p.start]
    by_word = sums(lengths)
    words = p.words_in()
    word_chars = by_word[p.word_at[1:]] - by_word[p.word_at[:-1]]
    symbols, upper, lower, digit, punct = (in_text(c) for c in kinds)
    d = p.digests()
    h = np.ascontiguousarray(d[:, 0])
    dup_lines, lines, short, repeat, distinct, longest = (np.zeros(n, np.int64) for _ in range(6))
    for i in range(n):
        a, b = int(p.word_at[i]), int(p.word_at[i + 1])
        if b == a:
            continue
        seen: set[bytes] = set()
        for line in p.text(i).split(b"\n"):
            k = len(line.split(None, 4))
            if k:
                lines[i] += 1
                short[i] += k < 4
                dup_lines[i] += line in seen
                seen.add(line)
        distinct[i] = len(np.unique(h[a:b]))
        longest[i] = lengths[a:b].max()
        if b - a > 3:
            again = _again(grams(h[a:b], 3))
            if again.any():  # by both hashes
                again &= _again(grams(np.ascontiguousarray(d[a:b, 1]), 3))
                cover = np.zeros(b - a, bool)
                for k in range(3):
                    cover[k : b - a - 2 + k] |= again
                repeat[i] = cover.sum()
    stats = np.stack([words, word_chars, symbols, dup_lines, repeat], 1).astype(np.int64)
    w, c, m = np.maximum(words, 1), np.maximum(word_chars, 1), np.maximum(lines, 1)
    features = np.stack(
        [
            np.minimum(np.log1p(words), 6), word_chars / w, symbols / w, dup_lines / m, repeat / w, upper / c, digit / c, punct / w,
            short / m, distinct / np.maximum(w**0.8, 1), np.minimum(longest, 60), np.log1p(words / m), lower / c,
        ],
        1,
    )
    return stats, features


@dataclass
class Forest:
    """Forests by number, their trees as arrays: of node j the split statistic and value, the first child (0: a leaf), and the path length of a leaf.

    ``cuts`` are the calibrated thresholds of the forests that tell bad rows.
    """

    trees: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    norm: float
    cuts: dict[int, float]

    def score(self, x: np.ndarray, k: int) -> np.ndarray:
        """0 to 1, higher: easier to isolate by forest k."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for stat, value, child, depth in self.trees[k]:
            at = np.zeros(len(x), np.int64)
            while (child[at] > 0).any():
                at = np.where(child[at] > 0, child[at] + (x[row, stat[at]] >= value[at]), at)
            total += depth[at]
        return 2.0 ** (-total / (max(1, len(self.trees[k])) * self.norm))

    def verdict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The main forest's score, and whether a calibrated score is at its threshold or above."""
        own, odd = self.score(x, MAIN), np.zeros(len(x), bool)
        for k, cut in self.cuts.items():
            odd |= (own if k == MAIN else self.score(x, k)) >= cut
        return own, odd


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def separation(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each statistic, how far it ranks bad rows apart from good ones: 0 to 1; all 1 without rows of both kinds."""
    n1, n0 = int((~good).sum()), int(good.sum())
    if not n1 or not n0:
        return np.ones(x.shape[1])
    out = []
    for column in x.T:
        _, at, times = np.unique(column, return_inverse=True, return_counts=True)
        rank = (np.cumsum(times) - (times + 1) / 2)[at]  # the mean of equal values
        out.append(abs(2 * (rank[~good].sum() - n1 * (n1 - 1) / 2) / (n1 * n0) - 1))
    return np.maximum(np.array(out), 1e-3)


def _tree(x: np.ndarray, weights: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One isolation tree over the rows ``x``; at each split a statistic is drawn by ``weights`` among those that vary."""
    stat, value, child, depth, todo = [0], [0.0], [0], [0.0], [(0, x, 0)]
    while todo:
        j, part, d = todo.pop()
        low, high = (part.min(0), part.max(0)) if len(part) else (weights, weights)
        share = weights * (low < high)
        if d >= limit or len(part) < 2 or not share.any():  # also the empty side of a draw at the very least value
            depth[j] = d + mean_path(len(part))
            continue
        k = int(rng.choice(len(share), p=share / share.sum()))
        stat[j], value[j], child[j] = k, float(rng.uniform(low[k], high[k])), len(value)
        right = part[:, k] >= value[j]
        for side in (part[~right], part[right]):
            todo.append((len(value), side, d + 1))
            stat.append(0), value.append(0.0), child.append(0), depth.append(0.0)
    return np.array(stat), np.array(value), np.array(child), np.array(depth)


def grow(x: np.ndarray, trees: int, rows: int, seed: int, weights: np.ndarray | None = None, own_trees: int = OWN_TREES) -> Forest:
    """The main forest of ``trees`` trees over all statistics, and a forest of each; each tree over ``rows`` random rows."""
    rng = np.random.default_rng(seed)
    size = min(rows, len(x))
    limit = int(np.ceil(np.log2(max(2, size))))
    every = np.arange(x.shape[1])
    of = {MAIN: (np.ones(len(every)) if weights is None else weights, trees), **{k: ((every == k).astype(float), own_trees) for k in every.tolist()}}
    out = {k: [_tree(x[rng.choice(len(x), size, replace=False)], w, limit, rng) for _ in range(n if size else 0)] for k, (w, n) in of.items()}
    return Forest(out, mean_path(max(2, size)), {})


def failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def ranked(values: DataFrame, stage: Stage, tag: str) -> DataFrame:
    """(k, v, good, bad) of each different value with ``good_from`` and ``bad_from``: how many rows of k have that value or a higher one."""
    counts = values.groupBy("k", "v").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    dealt = stage.table(counts.repartitionByRange("k", F.desc("v")).withColumn("part", F.spark_partition_id()), tag)
    above = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("k", "part").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("k", "part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    parts = parts.select("k", "part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("g", "b")])
    rows = dealt.join(F.broadcast(parts), ["k", "part"])
    return rows.select("k", "v", "good", "bad", (F.col("g_above") + F.sum("good").over(within)).alias("good_from"), (F.col("b_above") + F.sum("bad").over(within)).alias("bad_from"))


def separations(rows: DataFrame, stage: Stage, n_good: int, n_bad: int) -> np.ndarray:
    """What ``separation`` gives, of the rows (good, x) of a table."""
    if not n_good or not n_bad:
        return np.ones(FEATURES)
    each = ranked(rows.select("good", F.posexplode("x").alias("k", "v")), stage, "values")
    twice = F.sum(F.col("bad") * (2 * (n_good - F.col("good_from")) + F.col("good")))  # of pairs whose good row is lower, and once of equal ones
    won = {r["k"]: r["twice"] for r in each.groupBy("k").agg(twice.alias("twice")).collect()}
    stage.free("values")
    return np.maximum(np.abs(np.array([won[k] for k in range(FEATURES)]) / (n_good * n_bad) - 1), 1e-3)


def calibrate(forest: Forest, rows: DataFrame, stage: Stage, n_good: int, n_bad: int, max_loss: float) -> Forest:
    """Add thresholds while one catches more bad rows, the main forest's first; together they lose at most ``max_loss`` of the good ones.

    ``rows`` are all labelled ones as (good, x); each threshold is the best of all their scores.
    """
    if not n_good or not n_bad:
        return forest
    numbers = sorted(forest.trees)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)
            s = np.stack([forest.score(x, k) for k in numbers], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), len(numbers)).cast(pa.list_(pa.float64()))], ["good", "s"])

    open_, lost = stage.table(rows.select("good", "x").mapInArrow(kernel, "good boolean, s array<double>"), "scores"), 0
    while True:
        todo = [MAIN] if lost == 0 and not forest.cuts else [k for k in numbers if k not in forest.cuts]
        score = lambda k: F.col("s")[numbers.index(k)]
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), score(k).alias("v")) for k in todo]))
        best = (0, 0, 0.0, 0)
        if todo:
            cuts = ranked(open_.select("good", each.alias("e")).select("good", "e.*"), stage, "cuts")
            # The main forest may take half of what may be lost.
            fits = F.col("good_from") <= max_loss * n_good / (2 if todo == [MAIN] else 1) - lost
            gain = F.when(fits, F.col("bad_from") - 3 * F.col("good_from")).otherwise(0)
            # Of equal gains the highest score; of equal forests the first.
            tops = {r["k"]: r["top"] for r in cuts.groupBy("k").agg(F.max(F.struct(gain.alias("gain"), "v", "good_from")).alias("top")).collect()}
            for k in todo:
                if k in tops and tops[k]["gain"] > best[0]:
                    best = (tops[k]["gain"], k, tops[k]["v"], tops[k]["good_from"])
            if best[0]:  # the threshold lies halfway to the rows below
                below = cuts.where((F.col("k") == best[1]) & (F.col("v") < best[2])).agg(F.max("v").alias("v")).first()["v"]
                best = (*best[:2], (best[2] + (best[2] if below is None else below)) / 2, best[3])
            stage.free("cuts")
        if best[0] < max(3, 0.01 * n_bad):
            if MAIN in forest.cuts:
                return forest
            forest.cuts[MAIN] = np.inf  # the main forest tells no bad rows here
            continue
        forest.cuts[best[1]] = best[2]
        lost += best[3]
        open_ = open_.where(score(best[1]) < best[2])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id_, good, x) of every row with a label that passes the fixed rules; texts stay where they are read."""
    some = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id_")).agg((F.min(label_col) == 1).alias("good"))
    named = F.col("id_").cast("string")
    bits, bitmap = idfilter.bitmap(some.select(named.alias("id_")), "id_")
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    rows = rows.where("id_ is not null").select("*", idfilter.slot(bits, named))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = [np.empty(0, bool)], [np.empty((0, FEATURES))]
        for p in pieces(batch.column(1)):
            stats, features = statistics(p)
            base.append(failed(stats)), x.append(features)
        x = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x).ravel()), FEATURES).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(base)), x], ["id_", "failed", "x"])

    made = rows.mapInArrow(idfilter.passing(bitmap, kernel), rows.select("id_").schema.add("failed", "boolean").add("x", ArrayType(DoubleType())))
    return made.where("not failed").join(some, "id_").select("id_", "good", "x")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    trees: int = TREES, max_loss: float = MAX_LOSS, seed: int = 7,
) -> Forest:
    """A forest calibrated over all labelled rows of ``docs``."""
    stage = Stage(docs.sparkSession)
    try:
        rows = stage.table(labelled(docs, labels, id_col, text_col, label_col), "labelled")
        n, n_good = rows.agg(F.count("*"), F.count_if("good")).first()
        if not n:
            return grow(np.empty((0, FEATURES)), 0, ROWS_PER_TREE, seed)
        # What all trees together draw: from more rows than that, each has the same chance to be drawn.
        draws = (trees + FEATURES * OWN_TREES) * ROWS_PER_TREE
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id_"), F.lit(n)) < draws) if n > draws else rows
        x = drawn.select("x").toArrow()["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        x = x[np.lexsort(x.T)]  # rows arrive in any order; the forest must not depend on it
        forest = grow(x, trees, ROWS_PER_TREE, seed, separations(rows, stage, n_good, n - n_good))
        return calibrate(forest, rows, stage, n_good, n - n_good, max_loss)
    finally:
        stage.close()


VERDICT = "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ",base_failed:boolean,score:double,kept:boolean>"


def judge(forest: Forest):
    """An Arrow UDF from text to VERDICT."""

    @F.arrow_udf(VERDICT)
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            stats, score, odd = [np.empty((0, len(STATS)), np.int64)], [np.empty(0)], [np.empty(0, bool)]
            for p in pieces(texts):
                s, x = statistics(p)
                top, out = forest.verdict(x)
                stats.append(s), score.append(top), odd.append(out)
            s, score, odd = np.concatenate(stats), np.concatenate(score), np.concatenate(odd)
            base = failed(s)
            cols = [pa.array(s[:, k]) for k in range(len(STATS))]
            yield pa.StructArray.from_arrays([*cols, pa.array(base), pa.array(score), pa.array(~base & ~odd)], [*STATS, "base_failed", "score", "kept"])

    return verdict


def assess(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, STATS, ``base_failed``, ``score`` and ``kept`` of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    return rows.select(F.col("id_").alias(id_col), judge(forest)("text_").alias("v")).select(id_col, "v.*")


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass."""
    ship(docs.sparkSession)
    return docs.where(judge(forest)(F.col(text_col).cast("string"))["kept"])
