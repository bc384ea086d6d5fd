"""Vector code compression: product quantisation with integer codebooks and a partial-distance search.

A vector becomes integers, ``floor(scale * x)``, and is cut into equal consecutive parts; each part is named by the
nearest entry of its part's codebook. A codebook starts as that part of the rows with the least ids; each
round assigns all parts to their nearest entries and moves an entry to the componentwise floor of its parts' mean.

The search for the nearest entry takes a part's positions in descending variance of the codebook. It
adds up squared differences in integers, position by position, for a block of rows and all entries at once. A row's best complete
distance so far is that of the entry that led after some positions; a mask then drops each (row, entry) whose
sum strictly exceeds it, so only few are carried to the last position, and ties go to the lower index.

Rounds are scans of one written table; a partition hands on a sum and a count for each entry that it used, so what is
shuffled and what the driver gets (``parts * entries`` rows of sums) does not depend on the number of rows. Errors are
summed by label before rows meet their label's sum; labels of a thousandth of all rows or more, fewer than
``HOT`` + 1 by that, are joined by broadcast and never by key.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped, as are rows
whose components do not fit (``2**62`` bounds the distance of two vectors) and rows of another length than the
first kept row's. Vectors whose length no number of parts divides are filled up with zeros. Rows with null ids come last; rows of equal ids are taken in the order
of their vectors. Repeated rows each count and get equal codes. Fewer rows than entries give smaller codebooks; an
empty table gives an empty result. Texts are not read. Columns other than the three named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.store import Stage
from lumenlake.llm.textkit import column

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A label is hot with at least this share (1 / HOT) of all rows.
HOT = 1000
#: Rows of a block, positions summed for all entries, positions between two looks for a better complete distance.
BLOCK, DENSE, LOOK = 1024, 4, 4


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` (rows x positions) the nearest entry of ``c``, the lower of equals, and its squared distance."""
    x, c = x.astype(np.int64, copy=False), c.astype(np.int64, copy=False)
    order = np.argsort(-c.var(axis=0), kind="stable")
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    kind = np.int32 if len(order) * reach**2 < 2**31 else np.int64  # both are exact
    x, c = np.ascontiguousarray(x[:, order].T.astype(kind)), np.ascontiguousarray(c[:, order].T.astype(kind))
    codes, far = np.empty(x.shape[1], np.int64), np.empty(x.shape[1], np.int64)
    for i in range(0, x.shape[1], BLOCK):
        codes[i : i + BLOCK], far[i : i + BLOCK] = _block(x[:, i : i + BLOCK], c)
    return codes, far


def _block(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, n = x.shape
    head = min(DENSE, d)
    total = np.zeros((n, c.shape[1]), x.dtype)
    for k in range(head):
        step = x[k][:, None] - c[k]
        step *= step
        total += step
    whole = lambda entry: ((x - c[:, entry]) ** 2).sum(0)
    best = whole(total.argmin(1))
    row, entry = np.nonzero(total <= best[:, None])
    total = total[row, entry]
    for k in range(head, d):
        step = x[k][row] - c[k][entry]
        step *= step
        total += step
        if (k - head) % LOOK == LOOK - 1 and k + 1 < d:
            at = np.flatnonzero(np.diff(row, prepend=-1))
            lead = np.minimum.reduceat(total, at)
            first = np.flatnonzero(total == np.repeat(lead, np.diff(at, append=len(row))))
            guess = np.empty(n, np.int64)
            guess[row[first]] = entry[first]
            best = np.minimum(best, whole(guess))
        alive = total <= best[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    at = np.flatnonzero(np.diff(row, prepend=-1))
    low = np.minimum.reduceat(total, at)
    hit = np.flatnonzero(total == np.repeat(low, np.diff(at, append=len(row))))
    code = np.empty(n, np.int64)
    code[row[hit][::-1]] = entry[hit][::-1]  # the lowest entry is written last
    return code, low.astype(np.int64)


@dataclass
class Codebooks:
    """``entries``: parts x entries x positions, integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def split(self, flat: np.ndarray, rows: int) -> np.ndarray:
        """Vectors laid end to end as parts x rows x positions, filled up with zeros."""
        parts, _, width = self.entries.shape
        x = flat.reshape(rows, -1)
        out = np.zeros((rows, parts * width), np.int64)
        out[:, : x.shape[1]] = x
        return out.reshape(rows, parts, width).transpose(1, 0, 2)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (parts x rows) and the distances summed over parts."""
        found = [nearest(part, c) for part, c in zip(x, self.entries, strict=True)]
        return np.stack([code for code, _ in found]), sum(far for _, far in found)

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part and entry the sum of its parts and their number."""
        total, count = np.zeros(self.entries.shape, np.int64), np.zeros(self.entries.shape[:2], np.int64)
        codes, _ = self.assign(x)
        for p, code in enumerate(codes):
            order = np.argsort(code, kind="stable")
            at = np.flatnonzero(np.diff(code[order], prepend=-1))
            total[p, code[order][at]] = np.add.reduceat(x[p][order], at, axis=0)
            count[p] = np.bincount(code, minlength=count.shape[1])
        return total, count


def _vectors(batch: pa.RecordBatch, books: Codebooks) -> np.ndarray:
    col = column(batch, "q")
    return books.split(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(col))


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """(id, label, q) of the rows that are kept: q has the integers of the vector."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    q = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("x", lambda x: F.coalesce(F.abs(x.cast("double")) * (2.0 * scale) < F.sqrt(F.lit(2.0**60) / F.size("x")) - 2, F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("x"), q.alias("q"))
    return rows.where(F.col("x").isNotNull() & fits).select("id", "label", F.col("q").cast("array<int>").alias("q"))


def _round(table: DataFrame, books: Codebooks) -> Codebooks:
    """Assign all parts, and move the entries that are used."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = 0, 0
        for batch in batches:
            if len(batch):
                a, b = books.sums(_vectors(batch, books))
                total, count = total + a, count + b
        if isinstance(count, np.ndarray):
            part, entry = np.nonzero(count)
            rows = total[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists], ["part", "entry", "n", "total"])

    width = books.entries.shape[2]
    sums = table.select("q").mapInArrow(partial, "part long, entry long, n long, total array<long>").groupBy("part", "entry")
    moved = books.entries.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).cast("array<long>").alias("total")).collect():
        moved[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return Codebooks(moved)


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks of rows as ``whole_vectors`` gives them, and the rows that have the first one's length; None without rows."""
    least = lambda df, k: df.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(k).collect()
    first = least(table, 1)
    if not first:
        return None, table
    dims = len(first[0]["q"])
    table = table.where(F.size("q") == dims)
    start = np.array([r["q"] for r in least(table, entries)], np.int64).reshape(-1, dims)
    width = -(-dims // parts)
    books = Codebooks(np.zeros((parts, 0, width), np.int64))
    books.entries = np.ascontiguousarray(books.split(start, len(start)))
    for _ in range(rounds):
        books = _round(table, books)
    return books, table


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): two hex digits for each part (more where a codebook has over 256 entries)."""
    digits = max(2, len(f"{max(0, books.entries.shape[1] - 1):x}"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{i:0{digits}x}" for i in range(books.entries.shape[1])]
        for batch in batches:
            if len(batch):
                codes, error = books.assign(_vectors(batch, books))
                text = ["".join(names[i] for i in row) for row in codes.T.tolist()]
                yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "label"), pa.array(text), pa.array(error)], ["id", "label", "code", "error"])

    kinds = dict(table.dtypes)
    return table.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_label_error(stage: Stage, coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together."""
    totals = stage.table(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    rows = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT >= rows
    few = F.broadcast(totals.where(hot).select(F.col("label").alias("hot_label"), "label_error"))
    same = F.col("label").eqNullSafe(F.col("hot_label"))
    # A null label is hot or not as a whole; the others' keys are not null there but perhaps this one.
    rest = totals.where(~hot).select(F.col("label").alias("cold_label"), "label_error")
    cold = coded.join(few, same, "left_anti").join(rest, F.col("label").eqNullSafe(F.col("cold_label")))
    return coded.join(few, same).drop("hot_label").unionByName(cold.drop("cold_label"))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of each kept row."""
    stage = Stage(vectors.sparkSession)
    table = stage.table(whole_vectors(vectors, id_col, vector_col, label_col, scale), "vectors")
    books, table = train(table, parts, entries, rounds)
    if books is None:
        coded, digest = table.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), ""
    else:
        coded, digest = encode(table, books), books.sha256()
    out = with_label_error(stage, stage.table(coded, "codes"))
    stage.free("vectors")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
