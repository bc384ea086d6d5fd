"""Fitting of the quality rules over all labelled rows, against plain restatements in arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import quality
from lumenlake.llm.store import Stage


def plain_calibrate(forest, x, good, max_loss):
    scores = {k: forest.score(x, k) for k in forest.trees}
    open_, lost = np.ones(len(x), bool), 0
    while True:
        best = (0, 0, 0.0, 0)
        for k in [quality.MAIN] if lost == 0 and not forest.cuts else sorted(set(forest.trees) - set(forest.cuts)):
            for cut in sorted(set(scores[k][open_])):
                from_ = open_ & (scores[k] >= cut)
                gone, caught = int((from_ & good).sum()), int((from_ & ~good).sum())
                gain = caught - 3 * gone if gone <= max_loss * good.sum() / (2 if k == quality.MAIN else 1) - lost else 0
                if gain > best[0] or (gain == best[0] > 0 and k == best[1]):
                    under = scores[k][open_ & (scores[k] < cut)]
                    best = (gain, k, (cut + (under.max() if len(under) else cut)) / 2, gone)
        if best[0] < max(3, 0.01 * (~good).sum()):
            if quality.MAIN in forest.cuts:
                return forest.cuts
            forest.cuts[quality.MAIN] = np.inf
            continue
        forest.cuts[best[1]] = best[2]
        lost += best[3]
        open_ &= scores[best[1]] < best[2]


def test_thresholds_and_separation_over_parts(spark):
    rng = np.random.default_rng(3)
    good = np.arange(900) % 3 > 0
    x = np.round(rng.normal(0, 1, (900, quality.FEATURES)), 1)
    x[~good & (np.arange(900) % 2 == 0), 4] += 6
    x[~good & (np.arange(900) % 4 == 1), 7] -= 5
    rows = spark.createDataFrame([(bool(g), r.tolist()) for g, r in zip(good, x)], "good boolean, x array<double>").repartition(5)
    stage = Stage(spark)
    weights = quality.separations(rows, stage, int(good.sum()), int((~good).sum()))
    assert weights.tolist() == pytest.approx(quality.separation(x, good).tolist())
    forests = [quality.grow(x, 16, 64, 1, weights, own_trees=8) for _ in range(2)]
    got = quality.calibrate(forests[0], rows, stage, int(good.sum()), int((~good).sum()), 0.01).cuts
    stage.close()
    assert got == plain_calibrate(forests[1], x, good, 0.01) and len(got) > 1


def test_every_labelled_row_counts(spark):
    """Bad rows that come last in the order of hashes, behind 20 000 good ones."""
    ids = [r[0] for r in spark.range(20_400).orderBy(F.xxhash64("id")).collect()]
    bad = set(ids[-400:])
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(307)]
    text = lambda i: " ".join(("#$%" if i in bad and j % 2 else "") + words[(i * 7 + j * (i % 11 + 3)) % 307] for j in range(55))
    rows = spark.createDataFrame([(i, text(i), 0 if i in bad else 1) for i in ids], "doc_id long, text string, quality int").repartition(8)
    forest = quality.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    kept = quality.assess(rows.select("doc_id", "text"), forest).where("kept").select("doc_id").collect()
    left = {r["doc_id"] for r in kept}
    assert len(left & bad) <= 20 and len(left - bad) >= 0.998 * 20_000
