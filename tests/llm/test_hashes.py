"""Words made to collide under polynomial hashes must not count as equal anywhere."""

import itertools

import numpy as np

from lumenlake.llm import decontam, neardup, quality, substrings
from lumenlake.llm.textkit import of_texts, shingle_sets, shingles


def crafted(n=2048):
    """Two words, complements in the Thue-Morse order: sums of powers of any odd base agree modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ONE, TWO = crafted()
WORDS = [f"w{i}" for i in range(35)]
PAIR = [" ".join([*WORDS[:17], x, *WORDS[18:]]) for x in (ONE, TWO)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_digests_tell_words_apart():
    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product("aZ\x00é", repeat=n)]
    words += ["a" * n for n in range(4, 40)] + ["a" * n + "\x00" * k for n in (7, 8, 14, 15, 16) for k in range(1, 4)] + [ONE, TWO]
    words = list(dict.fromkeys(words))
    d = of_texts([" ".join(words)]).digests()
    assert d.shape == (len(words), 2) and all(len(np.unique(d[:, k])) == len(words) for k in range(2))
    again = of_texts([w for w in words]).digests()
    assert (d == again).all()  # the place of a word does not matter
    assert (of_texts(["ABC éÉ " + "X" * 20]).digests(fold=True) == of_texts(["abc éÉ " + "x" * 20]).digests()).all()


def test_sets_agree_with_sequences():
    texts = ["a b c d e", "a b", "", "a a a a a a", "A b C"]
    for n in (1, 3, 5):
        for t, s in zip(texts, shingle_sets(of_texts(texts), n), strict=True):
            assert (np.unique(shingles(of_texts([t]).digests(fold=True), n), axis=0) == s[np.argsort(s[:, 0])]).all() if len(s) else not t
    assert len({s.tobytes() for s in shingle_sets(of_texts(["a b c", "a b", "c b a"]), 3)}) == 3


def test_near_duplicates(spark):
    got = neardup.near_components(frame(spark, [*PAIR, PAIR[0]]), shingle=3, percent=95).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 0}


def test_passages(spark):
    got = substrings.remove_repeats(frame(spark, PAIR), window=35).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    got = substrings.remove_repeats(frame(spark, [*PAIR, PAIR[1]]), window=35).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 0, 1: 35, 2: 35}


def test_repeated_words():
    stats, _ = quality.statistics(of_texts([f"x {ONE} y z x {TWO} y", f"x {ONE} y z x {ONE} y"]))
    assert stats[:, quality.STATS.index("n_repeat_words")].tolist() == [0, 6]


def test_decontamination(spark):
    item = " ".join(["p q r s", ONE, "t u v x"])
    docs = frame(spark, [item, item.replace(ONE, TWO), "some text before " + item])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(docs, items).collect()) == [0, 2]


def test_one_equal_hash_is_not_enough():
    """Shingles that agree in the first hash alone are not shared."""
    a = np.array([[1, 10], [2, 20], [3, 30]], np.uint64)
    assert decontam._shared(a, np.array([[1, 10], [2, 21], [9, 30], [1, 10]], np.uint64)) == 1


def test_a_memory_of_segments_is_as_large_as_what_it_holds():
    """Keys that share slots are all found, unknown ones are not, and a table of few keys is small."""
    import numpy as np

    from lumenlake.llm.tokenout import Segments

    held = Segments(np.dtype(np.uint16))
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 1 << 62, 200_000).astype(np.uint64), rng.integers(1, 5, 200_000).astype(np.uint64)
    for part in np.array_split(np.arange(200_000), 7):
        held.put(low[part], high[part], part)
    assert (held.find(low, high) == np.arange(200_000)).all()
    assert (held.find(low + np.uint64(1 << 62), high) == -1).all()
    assert sum(x.nbytes for x in vars(held).values() if isinstance(x, np.ndarray)) < 32 << 20
