"""The background of the licence scan counts every line of every row."""

import numpy as np

from lumenlake.llm import licenses


def test_background_counts_every_line(spark):
    plain = [f"row {k} of the house\n\nof the garden number {k}" if k % 3 else f"word {k}\nReleased under the MIT License." for k in range(240)]
    texts = [*plain, None, "", "x" * 500 + " of the end", "of\nthe"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = licenses.background_of(docs)
    lines = [x for t in texts for x in (t or "").split("\n") if x.split()]
    held = [np.flatnonzero(np.isin(got.known, licenses.features_of(x))) for x in lines]
    every = [t for f in licenses.TEMPLATES for t in map(licenses.threes_of, licenses.notices(f)) if len(t)]
    clean = [not any(np.isin(t, licenses.compared(licenses._words(x))).mean() >= licenses.CONFIRMED for t in every) for x in lines]
    count = lambda sets: np.bincount(np.concatenate([np.empty(0, int), *sets]), minlength=len(got.known)).tolist()
    assert (got.lines, got.clean, got.words) == (len(lines), sum(clean), sum(len(x.split()) for x in lines)) and sum(clean) < len(lines)
    assert got.seen.tolist() == count(held) and got.seen_clean.tolist() == count([f for f, c in zip(held, clean) if c])


def test_background_of_no_rows(spark):
    got = licenses.background_of(spark.createDataFrame([], "doc_id long, text string"))
    assert got.lines == got.words == 0 and not got.draw(np.random.default_rng(1), 5)
    assert len(licenses.train(got).known) == len(got.known)
