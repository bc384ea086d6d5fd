"""Lexical search against plain scoring of all documents, and awkward rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenlake.llm import lexical
from lumenlake.llm.store import Stage

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DDL = "doc_id long, text string, id int, term string, shard string, block int, key int, items string, df int, rank int, score string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document."""
    held = [(i, ts) for i, t in docs if (ts := terms(t))]
    n, total, df, out = len(held), sum(len(t) for _, t in held), {}, []
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    for item, text in items:
        scored = []
        for i, ts in held:
            m = 100 - 90 + (90 * len(ts) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * (tf := ts.count(t)) // (1000 * tf + 8 * m)) for t in set(terms(text)) if t in ts)
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "t", "s", 2, 3, "i", 4, 5, "x") for i, t in rows], DDL).repartition(3)


def ranked(spark, docs, items, k=10):
    asked = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    return sorted((tuple(r) for r in lexical.rank_documents(frame(spark, docs), asked, k=k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_of_whole_texts():
    texts = ["", None, "Ab,cd", "é😀X y", "a" * 5, "\x00z\x7f", "end", "end", "ÀÉ x1Y2", "word " * 300_000, ",", "x"]
    seen = {}
    for first, _, found, where in lexical.tokens(pa.array(texts)):
        for t, w in zip(found.to_pylist(), where.tolist(), strict=True):
            seen.setdefault(first + w, []).append(t.decode())
    assert seen == {i: ts for i, t in enumerate(texts) if (ts := terms(t))}


def test_same_as_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(3000)] + ["É", "x1", "Tie"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40, 400])))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, ".,;"), (None, docs[6][1]), (2003, "W1 " * 20_000), (3, "again w3"), (3, "again w3")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 60])))) for i in range(12)] + [(50, docs[5][1]), (50, docs[5][1]), (51, None), (52, "unknown"), (53, ""), (None, docs[6][1]), (54, "again AGAIN")]
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, docs, items, k=1) == plain(docs, items, k=1)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "a")])])
def test_few_rows(spark, docs, items):
    assert ranked(spark, docs, items) == plain(docs, items)


def test_small_shards(spark, monkeypatch):
    """Shards end by documents and by bytes; a result does not depend on where."""
    rng, out = random.Random(8), []
    docs = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=rng.randrange(60)))) for i in range(500)]
    stage = Stage(spark)
    for most_docs, most_bytes in ((7, 1 << 20), (10_000, 4_000), (10_000, 1 << 25)):
        rows = list(_shards(docs, most_docs, most_bytes, monkeypatch))
        out.append([(r["term"], r["df"]) for r in rows])
        own = [r for r in rows if r["term"] == ""]
        assert sum(len(r["docs"]) // 8 for r in own) == sum(bool(terms(t)) for _, t in docs) and max(len(r["docs"]) // 8 for r in own) <= most_docs
    total = [{t: sum(d for x, d in rows if x == t) for t in "abcdefgh"} for rows in out]
    assert total[0] == total[1] == total[2] and len(out[0]) > len(out[1]) > len(out[2])
    index = lexical.build_index(stage, frame(spark, docs))
    assert index.docs == sum(bool(terms(t)) for _, t in docs) and index.terms == sum(len(terms(t)) for _, t in docs)


def _shards(docs, most_docs, most_bytes, monkeypatch):
    """Rows of the index as one task writes them."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", most_docs)
    monkeypatch.setattr(lexical, "SHARD_BYTES", most_bytes)
    ids, texts = pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])
    for batch in lexical.shards([(ids.slice(a, 90), texts.slice(a, 90)) for a in range(0, len(docs), 90)], 0, 400, 12_000):
        yield from batch.to_pylist()


def test_bytes_bound_impacts():
    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 2000, 5000), rng.integers(1, 100_000, 5000)
    exact = lexical.impact(tf, lexical.moderation(n, 10**6, 10**9))
    q = -(-exact // lexical.STEP)
    assert q.max() < 256 and (exact <= q * lexical.STEP).all() and (exact >= (q - 1) * lexical.STEP).all()
    big = lexical.moderation(np.array([10**8, 3]), 10**12, 10**14)
    assert big.tolist() == [10 + 90 * 10**8 * 10**12 // 10**14, 12]
