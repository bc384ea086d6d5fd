"""Vector codes against a plain restatement, and awkward rows."""

import hashlib

import numpy as np
import pytest

from lumenlake.llm import veccodes

DDL = "vec_id long, embedding array<float>, label int, id string, q string, x int, n int, code int, error string"


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, code, error) of each kept row in order of ids, and the codebooks, by loops over all entries."""
    kept = sorted((i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, vs in groups.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = []
    for i, v in kept:
        hits = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in hits), sum(d for d, _ in hits)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def frame(spark, rows):
    """rows: (id, vector, label); with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, k, "a", "b", 1, 2, 3, "c") for i, v, k in rows], DDL).repartition(3)


@pytest.mark.parametrize(("n", "d", "c", "reach"), [(700, 16, 256, 300), (50, 16, 256, 3), (300, 5, 40, 2), (64, 1, 7, 10), (10, 8, 1, 9), (40, 16, 30, 2**26), (9, 0, 3, 1)])
def test_nearest_entry(n, d, c, reach):
    rng = np.random.default_rng(n + d)
    x, book = rng.integers(-reach, reach, (n, d)), rng.integers(-reach, reach, (c, d))
    book[c // 2 :] = book[: c - c // 2]  # ties
    far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    code, error = veccodes.nearest(x, book)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all()


def test_same_as_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.1, 8)], int(i) % 3 or None) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[7][1], 9) for i in range(200)]  # copies
    got = veccodes.compress(frame(spark, rows)).collect()
    want, digest = plain([r[:2] for r in rows])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label, by = {i: k for i, _, k in rows}, {}
    for i, _, e in want:
        by[label[i]] = by.get(label[i], 0) + e
    assert all(r["label_error"] == by[label[r["vec_id"]]] for r in got)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, None, 1), (2, [0.1, None, 0.2, 0.3], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 2), (5, good, None), (5, good, None), (None, [0.1] * 4, None), (6, [1e30] * 4, 1), (7, [0.1] * 8, 1), (8, [], 1)]
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in veccodes.compress(frame(spark, rows)).collect()), key=str)
    assert got == [(5, "00000000", 0, 0), (5, "00000000", 0, 0), (None, "02020202", 0, 0)]
    odd = [(i, [float(i), 1.0, 2.0, 3.0, float(-i)], i) for i in range(5)]  # five positions: filled up to eight
    assert [r["error"] for r in veccodes.compress(frame(spark, odd)).collect()] == [0] * 5
    for none in (rows[:4], rows[:0]):
        empty = veccodes.compress(frame(spark, none))
        assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_hot_and_single_labels(spark, monkeypatch):
    monkeypatch.setattr(veccodes, "HOT", 4)
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 0.0], None if i % 5 == 0 else 1 if i % 2 else i) for i in range(120)]
    got = veccodes.compress(frame(spark, rows), entries=2, rounds=1).collect()
    label, by = {i: k for i, _, k in rows}, {}
    for r in got:
        by[label[r["vec_id"]]] = by.get(label[r["vec_id"]], 0) + r["error"]
    assert len(got) == 120 and all(r["label_error"] == by[label[r["vec_id"]]] for r in got)
