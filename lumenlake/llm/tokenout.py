"""Token-id output: texts as coded ids in files of checksummed blocks, and back.

Rows are dealt into shards by ranges of their id and sorted, so the shards in their order hold
all documents in ascending order. A shard is a file of frames. A frame holds whole documents
(at least ``FRAME_IDS`` ids but for the last) with their ids and lengths and the number of ids
before it in its shard, so frames are read back in any order and each by itself. The frame's
payload is in the format of ``rangecoder``. Spark's committer writes the files, so a lost task
leaves nothing behind and any store will do.

Only one row per shard is gathered to number the ids over all shards.

Defined results: a null text is empty and gives the end id alone; a null id comes first;
repeated rows are each written; an empty table gives an empty result; other columns are ignored. Very long texts
are encoded whole; rows of equal ids stand in the order of a hash of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.llm import rangecoder
from lumenlake.llm.textkit import buffers, lists, mix64
from lumenlake.plans.ship import ship

END_ID = 2
FRAME_IDS = rangecoder.BLOCK_IDS
#: Bytes of text that are cut into segments at a time.
PIECE = 1 << 21
#: Slots for segments that are kept for reuse, and the share that may be taken before all are dropped.
SLOTS, FULL = 1 << 22, 0.6
#: Segments of up to so many bytes are compared as two integers; longer ones, up to ``KEPT`` bytes, are kept by their bytes.
SHORT, KEPT = 15, 256
#: Unseen segments that are tokenised in one string.
JOINED = 100
FRAMES = "shard long, frame long, first long, doc_ids array<long>, lengths array<long>, payload binary"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: First bytes of the white space beyond ASCII, in two and in three bytes.
_WIDE2, _WIDE3 = np.zeros(256, bool), np.zeros(256, bool)
_WIDE2[0xC2], _WIDE3[[0xE1, 0xE2, 0xE3]] = True, True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Segments:
    """A hash table from the bytes of a segment to where its ids are; exact, as keys are whole segments."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.slot = np.zeros(SLOTS, np.int32)  # place of a key, from 1; 0 where free
        self.low, self.high, self.value = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.int64)
        self.pool, self.used, self.taken = np.empty(1 << 16, self.dtype), 0, 0
        self.long: dict[bytes, int] = {}

    def add(self, ids: np.ndarray) -> int:
        """Append ids to the pool; the place of the first."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(low ^ (high * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(SLOTS - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where unknown."""
        out, todo, at = np.full(len(low), -1), np.arange(len(low)), self._slot(low, high)
        while len(todo):
            key = self.slot[at] - 1
            held = key >= 0
            todo, at, key = todo[held], at[held], key[held]
            hit = (self.high[key] == high[todo]) & (self.low[key] == low[todo])
            out[todo[hit]] = self.value[key[hit]]
            todo, at = todo[~hit], (at[~hit] + 1) & (SLOTS - 1)
        return out

    def put(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Enter distinct unknown keys."""
        first, self.taken = self.taken, self.taken + len(low)
        if self.taken > len(self.low):
            size = max(self.taken, len(self.low) * 3 // 2)
            self.low, self.high, self.value = (np.concatenate([x[:first], np.empty(size - first, x.dtype)]) for x in (self.low, self.high, self.value))
        self.low[first : self.taken], self.high[first : self.taken], self.value[first : self.taken] = low, high, value
        at, key = self._slot(low, high), np.arange(first + 1, self.taken + 1, dtype=np.int32)
        while len(key):
            free = self.slot[at] == 0
            self.slot[at[free]] = key[free]  # of keys for one slot the last stays
            lost = self.slot[at] != key
            key, at = key[lost], (at[lost] + 1) & (SLOTS - 1)


class Encoder:
    """``tokenizers`` behind a memory of segments.

    A byte-level pre-tokeniser always starts a piece at white space after a non-space, so a
    text cut there has the ids of its segments one after the other.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = self.tokenizer.to_str()[:20_000]
        self.cuts = '"type":"ByteLevel","add_prefix_space":false' in shape and self.tokenizer.normalizer is None
        self.vocabulary = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.end = end_id
        self.known = Segments(np.dtype(np.uint16 if self.vocabulary <= 1 << 16 else np.uint32))
        # Bytes of text that each id stands for: one per letter of the byte-level alphabet.
        self.width = np.zeros(self.vocabulary, np.int64)
        added = self.tokenizer.get_added_tokens_decoder()
        for word, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(added[i].content.encode()) if i in added else len(word)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.known.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, segments: list[bytes]) -> np.ndarray:
        """Values of segments after their ids went to the pool; those that join without changing each other's pieces are tokenised together."""
        value = np.empty(len(segments), np.int64)
        joins = [k for k, s in enumerate(segments) if _SPACE[s[0]] and not (_SPACE[s[-1]] or s[-1] > 127)]
        groups = [joins[k : k + JOINED] for k in range(0, len(joins), JOINED)]
        rest = set(range(len(segments))) - set(joins)
        for group, ids in zip(groups, self._encode([b"".join([segments[k] for k in g]).decode() for g in groups])):
            ends = np.cumsum([len(segments[k]) for k in group])
            at = np.concatenate([[0], np.cumsum(self.width[ids])])
            cuts = np.searchsorted(at, np.concatenate([[0], ends]))
            if at[-1] == ends[-1] and (at[cuts] == np.concatenate([[0], ends])).all():
                value[group] = (self.known.add(ids) + cuts[:-1] << 32) + np.diff(cuts)
            else:
                rest.update(group)
        some = sorted(rest)
        for k, ids in zip(some, self._encode([segments[k].decode() for k in some])):
            value[k] = (self.known.add(ids) << 32) + len(ids)
        return value

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, an end id after each, and how many each text has; of texts as bytes and offsets."""
        offsets = offsets - offsets[0]
        n = len(offsets) - 1
        if not self.cuts:
            raw = data.tobytes()
            ids = self._encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            return np.concatenate([x for i in ids for x in (i, [self.end])] or [np.empty(0)]).astype(self.known.dtype), np.array([len(i) + 1 for i in ids], np.int64)
        if self.known.taken > FULL * SLOTS or len(self.known.long) > FULL * SLOTS / 16 or self.known.used > 1 << 25:
            self.known.clear()
        known = self.known
        space = _SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        # White space beyond ASCII may run on: no cut where the character before could be some.
        cut[2:] &= ~_WIDE2[data[:-2]]
        cut[3:] &= ~_WIDE3[data[:-3]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(data))
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        words = np.ndarray((len(data) + 16,), "<u8", padded, 0, (1,))
        low = words[start] & _MASKS[np.minimum(size, 8)]
        high = (words[start + 8] & _MASKS[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
        short = size <= SHORT
        value = np.full(len(start), -1)
        at = np.flatnonzero(short)
        value[at] = known.find(low[at], high[at])
        miss = at[value[at] < 0]
        if len(miss):
            order = miss[np.lexsort((high[miss], low[miss]))]
            new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            first = order[new]
            fresh = self._fresh([data[a : a + k].tobytes() for a, k in zip(start[first].tolist(), size[first].tolist())])
            known.put(low[first], high[first], fresh)
            value[order] = fresh[np.cumsum(new) - 1]
        long = np.flatnonzero(~short)
        if len(long):
            names = [data[a : a + k].tobytes() for a, k in zip(start[long].tolist(), size[long].tolist())]
            missing = list(dict.fromkeys(s for s in names if s not in known.long and len(s) <= KEPT))
            known.long.update(zip(missing, self._fresh(missing).tolist()))
            held = known.used
            huge = list(dict.fromkeys(s for s in names if len(s) > KEPT))
            once = dict(zip(huge, self._fresh(huge).tolist()))
            value[long] = [known.long[s] if len(s) <= KEPT else once[s] for s in names]
        else:
            held = known.used
        # An end id after the segments of each text.
        ends = np.searchsorted(start, offsets[1:])
        value = np.insert(value, ends, (known.add(np.array([self.end])) << 32) + 1)
        of = value & 0xFFFFFFFF
        upto = np.cumsum(of)
        ids = known.pool[np.repeat((value >> 32) - upto + of, of) + np.arange(int(upto[-1]) if len(upto) else 0)]
        known.used = held  # what is met once does not stay
        return ids, np.diff(upto[ends + np.arange(n)], prepend=0)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One per worker process, so that tasks of a worker share its segments."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(path, end_id), TaskContext.get().partitionId()
        names, coded, sizes, held, first, number = [], [], [], 0, 0, 0

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([first], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names)),
                    lists([np.concatenate(sizes)], pa.int64()),
                    pa.array([rangecoder.encode(np.concatenate(coded), code.vocabulary)], pa.binary()),
                ],
                ["shard", "frame", "first", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            data, at = buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
                ids, n = code(data[at[i] : at[j]], at[i : j + 1])
                names.append(batch.column(0).slice(i, j - i)), coded.append(ids), sizes.append(n)
                held, i = held + len(ids), j
                if held >= FRAME_IDS:
                    yield frame()
                    first, number, held, names, coded, sizes = first + held, number + 1, 0, [], [], []
        if names:
            yield frame()

    return run


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, order: list[Column] | None = None
) -> None:
    """Write the coded ids of all rows under ``path``, by ascending id or by ``order``."""
    ship(df.sparkSession)
    order = order or [F.col(id_col), F.xxhash64(F.col(text_col))]
    keys = [c.alias(f"key{i}_") for i, c in enumerate(order)]
    rows = df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"), *keys)
    names = [f"key{i}_" for i in range(len(keys))]
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("id_", "text_")
    dealt.mapInArrow(_writer(tokenizer, end_id), FRAMES).write.option("compression", "none").parquet(path)


def row_order(df: DataFrame) -> list[Column]:
    """The order in which a table read from Spark's part files was written: part number, then place in the file."""
    part = F.regexp_extract(F.col("_metadata.file_path"), r"part-([0-9]+)[^/]*$", 1)
    return [F.coalesce(part.try_cast("long"), F.lit(0)), F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = memoryview(rangecoder.decode(row["payload"]).astype("<u4").tobytes())
            n = np.array(row["lengths"], np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            if 4 * int(at[-1]) != len(raw):
                raise ValueError("a frame's ids do not match its documents")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(n), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + at[:-1]), pa.array(n), pa.array(crc, pa.int64())],
                ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at = rangecoder.decode(row["payload"]).astype(np.int32), np.cumsum([0, *row["lengths"]])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists([ids[a:b] for a, b in zip(at[:-1], at[1:])], pa.int32())], ["doc_id", "ids"])


def frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``ids`` of each document, decoded from the files."""
    ship(spark)
    return frames(spark, path).mapInArrow(_ids, "doc_id long, ids array<int>")


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from the decoded files."""
    ship(spark)
    table = frames(spark, path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = table.select("shard", size.alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select(F.col("shard").alias("shard_"), before.alias("before"))
    docs = table.mapInArrow(_reader, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    docs = docs.join(shards, F.col("shard") == F.col("shard_"))
    return docs.select(F.col("doc_id").alias(id_col), (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
