"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has almost no Jaccard similarity with it. So items are
partitioned by size (up to 4, 8, 16 ... shingles), and for each size class documents are
cut into overlapping parts of twice the class's size: an item of at most u shingles lies whole
in a part of 2u, where its similarity is 0.19 or more even at a containment of 0.8. Parts of
larger classes are unions of smaller ones, so their MinHash signatures come from pairwise
minima, and one pass over a document's shingles serves all classes. With 64 coordinates a
contained item shares none with its part with a probability below 2e-6.
Every candidate is confirmed by exact containment over the whole document.

Items are the query set: they are broadcast in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters, and each block is one scan of the documents without a shuffle.

Defined results: null or empty texts and items contain nothing; texts shorter than a shingle
are one shingle as a whole; items with equal texts are each reported, and so are items that repeat an id; repeated rows are each
searched; an empty table gives an empty result; other columns are ignored. Items' ids are cast to long. Very long texts are
searched whole; ties do not arise, as every item that is contained is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textkit import Piece, grams, mix32, mix64, of_texts, pieces, shingle_sets, shingles
from lumenlake.plans.ship import ship

SHINGLE, CONTAINMENT = 5, 80  # words, per cent
COORDINATES = 64
SMALLEST = 4  # shingles of the first size class
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 50_000_000
FOUND = "array<struct<item:bigint,shared:bigint,size:bigint>>"


def _place(g: np.ndarray) -> np.ndarray:
    return (mix64(g ^ np.uint64(0xA076_1D64_78BD_642F)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class SizeClass:
    """Items of at most ``SMALLEST << power`` shingles: (coordinate, minimum) names in order with their items, and a table of which may occur.

    All coordinates share the table, so it has about sixteen slots a name whatever the number of coordinates.
    """

    power: int
    names: np.ndarray
    items: np.ndarray
    seen: np.ndarray
    shift: np.uint32

    @staticmethod
    def build(power: int, numbers: np.ndarray, sets: list[np.ndarray]) -> SizeClass:
        place, at = _place(np.concatenate([s[:, 0] for s in sets])), np.cumsum([0, *map(len, sets)])[:-1]
        least = np.stack([np.minimum.reduceat(mix32(place + np.uint32(k)), at) for k in range(COORDINATES)])
        names = ((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[:, None] | least).ravel()
        order = np.argsort(names, kind="stable")
        bits = min(28, max(12, (16 * len(names)).bit_length()))
        out = SizeClass(power, names[order], np.tile(numbers, COORDINATES)[order], np.zeros(1 << bits, bool), np.uint32(32 - bits))
        for k in range(COORDINATES):
            out.seen[out.slots(least[k], k)] = True
        return out

    def slots(self, least: np.ndarray, k: int) -> np.ndarray:
        return least * np.uint32((2 * k + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> self.shift

    def items_of(self, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``least`` names an item in coordinate k, and the items."""
        hot = np.flatnonzero(self.seen[self.slots(least, k)])
        name = least[hot].astype(np.uint64) | np.uint64(k << 32)
        lo, hi = np.searchsorted(self.names, name, "left"), np.searchsorted(self.names, name, "right")
        n = hi - lo
        return np.repeat(hot, n), self.items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


@dataclass
class Index:
    """Items of one block: their sets, and their classes by size."""

    ids: list[int]
    sets: list[np.ndarray]
    classes: list[SizeClass]

    @staticmethod
    def build(ids: list[int], texts: list[str | None], shingle: int) -> Index:
        sets = list(shingle_sets(of_texts(texts), shingle))
        keep = [i for i, s in enumerate(sets) if len(s)]
        ids, sets = [ids[i] for i in keep], [sets[i] for i in keep]
        power = np.array([max(0, int(np.ceil(np.log2(len(s) / SMALLEST)))) for s in sets], np.int64)
        of = {c: np.flatnonzero(power == c) for c in sorted(set(power.tolist()))}
        return Index(ids, sets, [SizeClass.build(c, n, [sets[i] for i in n]) for c, n in of.items()])

    def candidates(self, g: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, from, to): parts g[from:to] that share a coordinate with an item."""
        if not len(g) or not self.classes:
            return []
        top, out = self.classes[-1].power, set()
        by_power = {c.power: c for c in self.classes}
        step = SMALLEST << top
        place = _place(g)
        for k in range(COORDINATES):
            low = np.full((-(-len(g) // step) + 1) * step, np.uint32(0xFFFFFFFF))
            low[: len(g)] = mix32(place + np.uint32(k))
            low = low.reshape(-1, SMALLEST).min(1)
            for c in range(top + 1):
                if c in by_power:
                    u = SMALLEST << c
                    part, items = by_power[c].items_of(np.minimum(low[:-1], low[1:]), k)
                    out.update((n, j * u, (j + 2) * u) for j, n in zip(part.tolist(), items.tolist()))
                low = np.minimum(low[0::2], low[1::2]) if c < top else low
        return list(out)


def _shared(item: np.ndarray, part: np.ndarray) -> int:
    """Shingles of an item (sorted by the first hash) that a part has, by both hashes."""
    at = np.minimum(np.searchsorted(item[:, 0], part[:, 0]), len(item) - 1)
    return len(np.unique(at[(item[at] == part).all(1)]))


def search(index: Index, p: Piece, shingle: int, containment: int) -> list[list[tuple[int, int, int]]]:
    """Of each text the (item id, shared shingles, item size) that it contains."""
    d, parts, at = p.digests(fold=True), [], [0]
    g = np.stack([grams(np.ascontiguousarray(d[:, k]), shingle) for k in range(2)], 1)
    for i in range(len(p)):
        a, b = int(p.word_at[i]), int(p.word_at[i + 1])
        parts.append(g[a : b - shingle + 1] if b - a >= shingle else shingles(d[a:b], shingle))
        at.append(at[-1] + len(parts[-1]))
    ends = np.array(at)
    pairs = set()
    for n, lo, hi in index.candidates(np.concatenate(parts)[:, 0] if parts else g[:0, 0]):
        first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, min(hi, at[-1]), "left")
        pairs.update((i, n) for i in range(first, min(last, len(p))))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(p))]
    for i, n in sorted(pairs):
        shared = _shared(index.sets[n], parts[i])
        if shared * 100 >= containment * len(index.sets[n]):
            out[i].append((index.ids[n], shared, len(index.sets[n])))
    return out


def _finder(index_: object, shingle: int, containment: int):
    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = index_.value
        for texts in batches:
            rows = [r for p in pieces(texts) for r in search(index, p, shingle, containment)]
            flat = [x for r in rows for x in r]
            struct = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], ["item", "shared", "size"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), struct)

    return find


def _blocks(items: DataFrame, item_col: str, text_col: str, shingle: int) -> Iterator[Index]:
    ids, texts, chars = [], [], 0
    for row in items.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        ids.append(row[0]), texts.append(row[1])
        chars += len(row[1] or "")
        if len(ids) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield Index.build(ids, texts, shingle)
            ids, texts, chars = [], [], 0
    yield Index.build(ids, texts, shingle)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, containment: int = CONTAINMENT,
) -> DataFrame:
    """``id_col``, ``item_col``, ``n_shared``, ``n_item``: documents that contain at least ``containment`` per cent of an item's shingles."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    out = None
    for index in _blocks(items, item_col, item_text, shingle):
        find = _finder(spark.sparkContext.broadcast(index), shingle, containment)
        hits = rows.select("id_", find("text_").alias("found")).select("id_", F.explode("found").alias("x"))
        hits = hits.select(F.col("id_").alias(id_col), F.col("x.item").alias(item_col), F.col("x.shared").alias("n_shared"), F.col("x.size").alias("n_item"))
        out = hits if out is None else out.union(hits)
    return out


def drop_leaked(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: int = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    spark = docs.sparkSession
    ship(spark)
    for index in _blocks(items, item_col, item_text, shingle):
        find = _finder(spark.sparkContext.broadcast(index), shingle, containment)
        docs = docs.where(F.size(find(F.col(text_col).cast("string"))) == 0)
    return docs
