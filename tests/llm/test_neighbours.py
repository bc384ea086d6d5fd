"""Votes of neighbours against plain loops, accuracy on rows held out, and awkward rows."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import neighbours, queries
from lumenlake.llm.textkit import of_texts, pieces

GOOD = ["The river runs past the old mill, and the road follows it.", "A quiet house stood there; nobody knew whose it was.", "Rain fell. The fields were green again by the end of May.", "She wrote that the train was late, but nobody minded."]
BAD = ["Buy!!! NOW!!! BEST!!! PRICE!!! CLICK!!! HERE!!!", "word word word word word word word word", "a### b%%% c&&& d$$$ e### f%%% g&&&", "x | y | z | w | v | u | t | s | r"]


def small():
    return neighbours.train([*GOOD, *BAD], np.array([1] * 4 + [0] * 4))


def test_votes_as_loops_give_them():
    model = small()
    asked = ["The mill and the house were old, and quiet.", "CALL!!! NOW!!! FREE!!!", "go go go go go go", "", "123 456"]
    x = np.concatenate([model.project(p) for p in pieces(pa.array(asked))])
    for v, got, score in zip(x, model.votes(x), model.score(of_texts(asked)), strict=True):
        cos = [sum(float(a) * float(b) for a, b in zip(v, u, strict=True)) for u in model.vectors]
        w = [math.exp(neighbours.SHARP * (c - max(cos))) for c in cos]
        one, two = sum(w[:4]) / 4, sum(w[4:]) / 4
        assert got == pytest.approx(one / (one + two), rel=1e-3, abs=1e-6)
        assert score == pytest.approx(float(neighbours.moved(np.array([got]), model.threshold)[0]), abs=1e-6)
    assert model.votes(x[:1])[0] > 0.5 > model.votes(x[1:2])[0] and model.votes(x[2:3])[0] < 0.5
    assert model.votes(x[3:4])[0] == pytest.approx(0.5)


def test_directions_are_those_of_the_decomposition():
    rng = np.random.default_rng(5)
    dense = (rng.random((30, 8)) @ rng.random((8, 200))).astype(np.float32) + 0.01 * rng.random((30, 200), np.float32)
    row, slot = np.nonzero(dense)
    sparse = neighbours.Weighted(row, slot, dense[row, slot], 30)
    _, _, v = np.linalg.svd(dense, full_matrices=False)
    got = neighbours.decompose(sparse, 5)
    assert got.shape == (neighbours.TOTAL, 5) and (np.abs((v[:5] * got[:200].T).sum(1)) > 0.99).all()
    assert np.allclose(sparse.times(got, step=7), dense @ got[:200], atol=1e-4)


def test_features_do_not_depend_on_pieces():
    texts = ["", "one", "TWO two!! two", "x " * 2000, "é😀 1,2", "a a b a"]
    whole = list(zip(*(x.tolist() for x in neighbours.features(of_texts(texts))), strict=True))
    apart = [(i, s, c) for i, t in enumerate(texts) for _, s, c in zip(*(x.tolist() for x in neighbours.features(of_texts([t]))), strict=True)]
    assert whole == apart


def test_threshold():
    share, label = np.array([0.1, 0.2, 0.2, 0.6, 0.7, 0.9]), np.array([0, 0, 0, 0, 1, 1])
    assert neighbours.best_threshold(share, label) == pytest.approx(0.65)
    assert neighbours.moved(np.array([0.0, 0.65, 0.66, 1.0]), 0.65).tolist() == pytest.approx([0, 0.5, 0.514285, 1], abs=1e-4)
    assert (np.diff(neighbours.moved(np.linspace(0, 1, 50), 0.9)) > 0).all()


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op13_neighbours(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 80 and sum(good) >= 0.95 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_labels_of_rows_held_out_are_not_read(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    a = neighbours.fit(docs, labels, ~out)
    b = neighbours.fit(docs, labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))), ~out)
    assert (a.vectors == b.vectors).all() and (a.label == b.label).all() and a.threshold == b.threshold


def test_awkward_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word " * 50_000), (5, GOOD[0]), (5, GOOD[0]), (None, BAD[0]), (6, "😀"), (7, "##")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "score", "y", "use", "n", "t", "label")}).repartition(3)
    got = sorted(((r["doc_id"], r["score"]) for r in neighbours.score_quality(docs, small()).collect()), key=str)
    assert len(got) == 9 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1] == by[2] == by[3] and by[5] > 0.5 > by[None] and by[4] < 0.5
    assert len({s for i, s in got if i == 5}) == 1
    assert neighbours.score_quality(docs.where("false"), small()).count() == 0
    labels = spark.createDataFrame([(5, 1), (4, 0), (5, 1), (1, 0), (None, 1), (9, 0), (6, None)], "doc_id long, quality int")
    model = neighbours.fit(docs, labels)
    assert sorted(model.label.tolist()) == [0, 1]
    monkeypatch.setattr(neighbours, "SAMPLE_WORDS", 1000)  # the long text is passed over: one label is left
    alone = neighbours.fit(docs, labels)
    assert {r["score"] for r in neighbours.score_quality(docs, alone).collect()} == {1.0}
    none = neighbours.fit(docs, labels.where("false"))
    assert {r["score"] for r in neighbours.score_quality(docs, none).collect()} == {0.5}
