"""Ranked lexical search over a two-level quantised index.

Terms are maximal runs of ASCII letters, digits and code points from U+0080 on, with A-Z as a-z. Of a document with n
terms, N such documents and L terms in all, m is ``100 - B + (B * n * N) div L`` with B = 90; a term that occurs tf times in it has the impact
``(10**9 * tf) div (1000 * tf + 8 * m)``, below 10**6, and a score sums weight times impact over an item's terms. All of it is exact integers.

The index is a table of shards of documents. A row holds one term's postings in one shard: the documents' numbers
in the shard, for the first level a byte for each (the impact in steps of ``STEP``, rounded upward), and for the second
level the tf. The row of the empty term holds the shard's document ids and lengths. Terms are strings, never hashes.

A search meets the rows of the items' terms by a join, shard by shard. With q the bytes, ``STEP * sum(w * q)`` bounds a document's
score from above and ``STEP * sum(w * (q - 1))`` from below. Every document of the shard whose upper bound reaches the kth
lower bound is scored exactly from the second level; the shard's k best go on. So nothing is lost: a
document of the k best is among the k best of its shard. The first level reads a byte and a number for each posting; the second is
looked up for candidates alone.

Bounds: a shard has at most ``SHARD_DOCS`` documents and about ``SHARD_BYTES`` of text (one text alone may have more);
items are dealt to blocks of about ``BLOCK_ITEMS``, so a group has one shard's rows and one block's weights. Neither items nor
postings pass through the driver, and no term's postings meet in one task.

Defined results: null, empty and termless texts are in no count and never found; an item without text or known terms gets no
rows. Equal scores go by ascending id, null ids last; repeated documents are found one by one, repeated items answered
one by one. Very long texts are taken whole. An empty table gives an empty result. Document ids are cast to long; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.store import Stage
from lumenlake.llm.textkit import PIECE, buffers, column
from lumenlake.plans.ship import ship

#: Step of a byte: 255 of them reach the largest impact.
STEP = 3922
#: Share of a document's length in m, per cent.
B = 90
SHARD_DOCS, SHARD_BYTES, BLOCK_ITEMS = 16_384, 32 << 20, 256
#: Bytes of terms as they count, 0 for all others.
_TERM = np.zeros(256, np.uint8)
_TERM[128:] = np.arange(128, 256)
for _a, _b, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97)):
    _TERM[_a:_b] = np.arange(_to, _to + _b - _a)
_SPLIT = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_ROW = "shard long, term string, df int, docs binary, impacts binary, tfs binary"


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Texts in pieces: the number of the first text and of the texts, their terms, and each term's text."""
    data, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        low, cuts = _TERM[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        held = np.concatenate([[False], low != 0, [False]])
        fresh, last = held[1:-1].copy(), held[1:-1].copy()  # what stands before and after is another term's or none
        fresh &= ~held[:-2]
        last &= ~held[2:]
        inner = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(low))]
        fresh[inner] |= held[1:-1][inner]
        last[inner - 1] |= held[1:-1][inner - 1]
        start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        flat = low[low != 0]
        yield i, j - i, pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]), np.searchsorted(cuts[1:], start, side="right")
        i = j


def moderation(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms each; exact also where 64 bits are too few for what is divided."""
    if int(n.max(initial=0)) * B * docs < 2**63:
        return 100 - B + (n.astype(np.int64) * (B * docs)) // terms
    return np.array([100 - B + int(x) * B * docs // terms for x in n], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (tf * 1_000_000_000) // (tf * 1000 + m * 8)


@dataclass
class Index:
    """``table`` as described above; ``docs`` documents have ``terms`` terms."""

    table: DataFrame
    docs: int
    terms: int


def count_terms(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms of documents with repeats."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for batch in batches:
            for _, _, found, where in tokens(batch.column(0)):
                some, total = some + len(np.unique(where)), total + len(found)
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["some", "total"])

    row = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


class _Shard:
    """Documents gathered until the shard is full."""

    def __init__(self) -> None:
        self.terms: list[pa.Array] = []
        self.doc: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.n: list[np.ndarray] = []
        self.docs = self.bytes = 0

    def add(self, ids: pa.Array, found: pa.Array, where: np.ndarray) -> None:
        have, at, n = np.unique(where, return_inverse=True, return_counts=True)
        self.terms.append(found)
        self.doc.append((at + self.docs).astype(np.int64))
        self.ids.append(ids.take(pa.array(have)))
        self.n.append(n)
        self.docs += len(have)
        self.bytes += found.nbytes

    def rows(self, shard: int, docs: int, terms: int) -> pa.RecordBatch:
        coded = pa.chunked_array(self.terms).dictionary_encode().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        n = np.concatenate(self.n)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * self.docs + np.concatenate(self.doc), return_counts=True)
        term, doc = np.divmod(key, self.docs)
        q = (-(-impact(tf, moderation(n, docs, terms)[doc]) // STEP)).astype(np.uint8)
        at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))])
        cells = lambda flat, size: pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
        ids = pa.chunked_array(self.ids).combine_chunks()
        own = (ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), n.astype(np.int32).tobytes())
        columns = [pa.concat_arrays([pa.array([x], pa.large_binary()), y]).cast(pa.binary()) for x, y in zip(own, (cells(doc.astype(np.uint16), 2), cells(q, 1), cells(tf.astype(np.int32), 4)), strict=True)]
        words = pa.concat_arrays([pa.array([b""], pa.large_binary()), coded.dictionary]).cast(pa.binary()).cast(pa.string())
        df = np.concatenate([[0], np.diff(at)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), shard, np.int64)), words, pa.array(df), *columns], ["shard", "term", "df", "docs", "impacts", "tfs"])


def shards(batches: Iterable[tuple[pa.Array, pa.Array]], first_shard: int, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """Index rows of (ids, texts), shard by shard."""
    shard, made = _Shard(), first_shard
    for ids, texts in batches:
        for first, size, found, where in tokens(texts):
            for a in range(0, size, SHARD_DOCS):  # a piece may have more texts than a shard takes
                many = min(SHARD_DOCS, size - a)
                lo, hi = np.searchsorted(where, [a, a + many])
                part = found.slice(lo, hi - lo)
                if shard.docs and (shard.docs + many > SHARD_DOCS or shard.bytes + part.nbytes > SHARD_BYTES):
                    yield shard.rows(made, docs, terms)
                    shard, made = _Shard(), made + 1
                if hi > lo:
                    shard.add(ids.slice(first + a, many), part, where[lo:hi] - a)
    if shard.docs:
        yield shard.rows(made, docs, terms)


def build_index(stage: Stage, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Two scans: of lengths, which impacts need, and of postings. Every row is indexed."""
    some, total = count_terms(docs, text_col)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from shards(((column(b, "id"), column(b, "text")) for b in batches), TaskContext.get().partitionId() << 32, some, total)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return Index(stage.table(rows.mapInArrow(post, _ROW), "index"), some, total)


def weight(index: Index, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * index.docs + 2)) / (2 * df + 1).cast("double")))


def best_of_shard(rows: pa.Table, k: int, docs: int, terms: int) -> pa.Table:
    """The k best documents of each item in one shard; ``rows`` are index rows with the (key, w) of the items that ask for the term."""
    names = column(rows.combine_chunks().to_batches()[0], "term").to_pylist()
    docs_of, impacts_of, tfs_of = (rows[c].to_pylist() for c in ("docs", "impacts", "tfs"))
    asked: dict[int, list[tuple[int, int]]] = {}
    m = ids = absent = None
    for j, (name, items) in enumerate(zip(names, rows["items"].to_pylist(), strict=True)):
        if name == "":
            ids, absent = np.frombuffer(docs_of[j], np.int64), np.frombuffer(impacts_of[j], np.uint8)
            m = moderation(np.frombuffer(tfs_of[j], np.int32), docs, terms)
        else:
            for item in items:
                asked.setdefault(item["key"], []).append((j, item["w"]))
    where = [np.frombuffer(d, np.uint16) if n else None for d, n in zip(docs_of, names, strict=True)]
    level = [np.frombuffer(b, np.uint8).astype(np.int64) if n else None for b, n in zip(impacts_of, names, strict=True)]
    out: list[tuple[np.ndarray, ...]] = []
    for key, parts in asked.items():
        upper, lower = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for j, w in parts:
            step = level[j] * w
            upper[where[j]] += step
            lower[where[j]] += step - w * (level[j] > 0)
        maybe = upper > 0
        if maybe.sum() > k:
            maybe &= upper >= np.partition(lower, len(lower) - k)[len(lower) - k]  # both in steps
        found = np.flatnonzero(maybe)
        score = np.zeros(len(found), np.int64)
        for j, w in parts:
            at = np.minimum(np.searchsorted(where[j], found), len(where[j]) - 1)
            hit = where[j][at] == found
            score[hit] += w * impact(np.frombuffer(tfs_of[j], np.int32)[at[hit]], m[found[hit]])
        found, score = found[score > 0], score[score > 0]
        top = np.lexsort((ids[found], absent[found], -score))[:k]
        out.append((np.full(len(top), key, np.int64), ids[found[top]], absent[found[top]], score[top]))
    key, doc, none, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
    return pa.table({"key": key, "doc_id": pa.array(doc, mask=none.astype(bool)), "score": score})


def search(stage: Stage, index: Index, items: DataFrame, *, k: int = 10, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of highest score above 0."""
    fold = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(fold, F.lit(_SPLIT)))
    # Written, as the keys must be the same wherever they are read.
    asked = stage.table(items.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item"), found.alias("terms")), "items")
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))
    wanted = asked.select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))
    df = index.table.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = wanted.join(df.select("term", weight(index, F.col("df")).alias("w")), "term")
    by_term = weighed.groupBy("block", "term").agg(F.collect_list(F.struct("key", "w")).alias("items"))  # as many as a block has items
    every = asked.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).distinct().select("block", F.lit("").alias("term"), F.array().cast("array<struct<key:bigint,w:bigint>>").alias("items"))
    lists = stage.table(by_term.unionByName(every), "item-terms")
    docs, terms = index.docs, index.terms

    def best(rows: pa.Table) -> pa.Table:
        return best_of_shard(rows, k, docs, terms)

    met = index.table.drop("df").join(lists, "term")
    top = met.groupBy("shard", "block").applyInArrow(best, "key long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item"), "key").select(F.col("item").alias(item_id), "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """Index all documents and answer all items."""
    stage = Stage(docs.sparkSession)
    return search(stage, build_index(stage, docs), items, k=k)
