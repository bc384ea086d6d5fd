"""Removal of word passages that repeat anywhere in the corpus, by prefix-partitioned suffix trees.

The corpus is one string of words; a window of ``window`` words repeats if the suffix tree
has an internal node of at least that depth above its suffix. The tree is built in subtrees:

1. Texts with the same words form one class, so a group of copies counts once. A class
   of several texts lies under deep nodes as a whole.
2. Each window is filed under its least ``gram`` words by hash (its anchor). Equal windows have equal
   anchors, so a window whose anchor occurs once has no deep node and its suffix is left out.
   This is exact, and only the anchors (one word in fourteen) are shuffled.
3. Subtrees are split by these words: all suffixes that could share a deep node have the anchor's
   words as a common prefix, counted from the anchor. Neighbouring windows mostly share their anchor, so their
   suffixes travel as one string of words (a run), some three words a suffix. Equal runs are one, with a count.
4. A task holds some subtrees at a time. It sorts their suffixes by their words (ranks of 1, 2, 4 ... words,
   from the words themselves), takes the common prefix of neighbours in that order, and so the depth of the
   deepest internal node above each suffix. Depths of ``window`` or more are repeats; one
   that is not the tail of a longer one, a word to the left, is a maximal repeat of its run.
5. An anchor with more than ``MOST_RUNS`` different runs is too large for a task's memory. Its prefix is lengthened to
   the whole window: such a subtree is one path, whose node is found by counting equal windows.

Words are compared as they are; hashes only choose anchors, and 128 bits of a SHA-256 name texts and runs.

Defined results: a null or empty text has no words; its kept text is empty. Repeated rows are
copies of each other. Rows that repeat a doc_id are each judged on their own text. An empty
table gives an empty result; other columns are ignored. Ids are cast to long. Very long texts are taken whole;
ties do not arise, as every occurrence of a repeat goes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import idfilter
from lumenlake.llm.store import Stage
from lumenlake.llm.textkit import buffers, column, grams, lists, piece, pieces

WINDOW, GRAM = 50, 8
#: Different runs of an anchor, and words that a task sorts at a time (a group of runs more).
MOST_RUNS, WORDS = 1_024, 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def anchors(g: np.ndarray, windows: int, span: int) -> np.ndarray:
    """Of each window the place of its least gram (the last of equal ones): ``span`` grams per window.

    ``windows`` + ``span`` - 1 equals len(g). Works by block-wise running minima, so the time
    does not depend on ``span``. Ties are equal grams, so equal windows still agree.
    """
    n = len(g)
    blocks = -(-n // span)
    full = np.full(blocks * span, np.uint64(2**64 - 1))
    full[:n] = g
    grid = full.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows])


def _survey(window: int, gram: int):
    """Of each text: ids and digest of its words, and its anchors (those it holds more than once twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sha, anc = [], [], [], [], []
            for p in pieces(column(batch, "text_")):
                h = p.hashes()
                g = grams(h, gram)
                for i in range(len(p)):
                    a, b = int(p.word_at[i]), int(p.word_at[i + 1])
                    digest = _digest(p.text(i))
                    x, y = _name(digest)
                    n.append(b - a), h1.append(x), h2.append(y), sha.append(digest.hex())
                    w = b - a - window + 1
                    if w > 0:
                        mine = g[a : b - gram + 1]
                        least = anchors(mine, w, window - gram + 1)
                        least = np.unique(least[np.flatnonzero(np.diff(least, prepend=~least[:1]))])
                        seen, times = np.unique(mine, return_counts=True)
                        again = least[times[np.searchsorted(seen, least)] > 1]
                        anc.append(np.concatenate([least, again]).view(np.int64))
                    else:
                        anc.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sha, pa.string()), lists(anc, pa.int64())],
                ["id_", "n", "h1", "h2", "sha", "anchors"],
            )

    return run


def _digest(text: bytes) -> bytes:
    """SHA-256 of the words, joined by one space."""
    return hashlib.sha256(b" ".join(text.split())).digest()


def _name(digest: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", digest[:16])


def _is(batch: pa.RecordBatch, k: int, text: bytes) -> bool:
    """Whether row k names ``text``; an id may repeat with other texts."""
    return _name(_digest(text)) == (column(batch, "h1")[k].as_py(), column(batch, "h2")[k].as_py())


def _runs(window: int, gram: int):
    """Stretches of windows with one anchor, of those in ``anchors``: class, first window, anchor, words, whether the class is one text."""
    span = window - gram + 1

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, place, anchor, text = [], [], [], []
        flags = column(batch, "anchors")
        for p in pieces(column(batch, "text_")):
            h = p.hashes()
            g = grams(h, gram)
            for i in range(len(p)):
                a, b = int(p.word_at[i]), int(p.word_at[i + 1])
                w = b - a - window + 1
                if w <= 0 or not _is(batch, p.first + i, p.text(i)):
                    continue
                least = anchors(g[a : b - gram + 1], w, span)
                first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
                last = np.append(first[1:], w)
                known = np.isin(least[first], np.asarray(flags[p.first + i].values).view(np.uint64))
                for lo, hi in zip(first[known].tolist(), last[known].tolist()):
                    for x in range(lo, hi, span):  # equal grams in a row could make a run as long as the text
                        y = min(x + span, hi) + window - 1
                        words = p.data[int(p.start[a + x]) : int(p.end[a + y - 1])].tobytes().split()
                        of.append(p.first + i), place.append(x), anchor.append(least[lo])
                        text.append(b" ".join(words).decode() + " ")
        of = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *(column(batch, c).take(of) for c in ("h1", "h2")),
                pa.array(place, pa.int32()),
                pa.array(np.array(anchor, np.uint64).view(np.int64)),
                pa.array(text, pa.string()),
                pc.equal(column(batch, "copies").take(of), 1),
            ],
            ["h1", "h2", "place", "anchor", "words", "alone"],
        )

    return kernel


def suffix_order(rank: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ranks of all suffixes of runs of words, a run ending below any word, and the ranks of their first 1, 2, 4 ... words.

    ``rank`` numbers words from 1; ``end`` is, of each word, where its run ends.
    """
    at, levels, k = np.arange(len(rank)), [(1, rank)], 1
    longest = int((end - at).max()) if len(rank) else 0
    while k < longest:
        after = np.where(at + k < end, rank[np.minimum(at + k, len(rank) - 1)], 0)
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
        k *= 2
        levels.append((k, rank))
    return rank, levels


def common_prefix(a: np.ndarray, b: np.ndarray, end: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Words that the suffixes at a and b have in common from their starts."""
    most = np.minimum(end[a] - a, end[b] - b)
    d = np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        on = np.flatnonzero(d < most)
        on = on[rank[a[on] + d[on]] == rank[b[on] + d[on]]]
        d[on] += k
    return np.minimum(d, most)


def deepest(texts: pa.Array, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least ``window`` words in runs: number of the run, first word, words."""
    data, offsets = buffers(texts)
    p = piece(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    n = len(p.start)
    # A word with the space after it, so that words stand one after the other and are told apart exactly.
    at = np.append(p.start, len(p.data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(p.data))])
    rank = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    run = np.repeat(np.arange(len(p)), p.words_in())
    end = p.word_at[1:][run]
    order, levels = suffix_order(rank, end)
    leaf = np.flatnonzero(np.arange(n) + window <= end)
    leaf = leaf[np.argsort(order[leaf], kind="stable")]
    shared = common_prefix(leaf[:-1], leaf[1:], end, levels)
    depth = np.zeros(n + 1, np.int64)
    depth[leaf[1:]] = shared
    depth[leaf[:-1]] = np.maximum(depth[leaf[:-1]], shared)
    whole = leaf[copies[run[leaf]] > 1]
    depth[whole] = end[whole] - whole
    deep = np.flatnonzero(depth[:n] >= window)
    # The tail of a repeat that starts a word earlier in the run is not maximal.
    tail = (deep > p.word_at[run[deep]]) & (depth[deep - 1] > depth[deep])
    deep = deep[~tail]
    return run[deep], deep - p.word_at[run[deep]], depth[deep]


def _subtrees(window: int):
    """Repeats of runs in order of their anchors, some subtrees at a time: key, starts, lengths."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        text, key = rows["words"].combine_chunks(), rows["key"].combine_chunks()
        run, start, length = deepest(text, rows["copies"].to_numpy(), window)
        cut = np.flatnonzero(np.diff(run, prepend=-1))
        bounds = pa.array(np.append(cut, len(run)), pa.int32())
        of = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32()))
        return pa.RecordBatch.from_arrays([key.take(pa.array(run[cut])), of(start), of(length)], ["key", "starts", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(pc.sum(pc.binary_length(column(batch, "words"))).as_py() or 0)
            if size < 6 * WORDS:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows["anchor"].to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))  # the last subtree may go on
            if last:
                yield found(rows.slice(0, last))
                held = rows.slice(last).to_batches()
                size = sum(int(pc.sum(pc.binary_length(column(b, "words"))).as_py() or 0) for b in held)
        if held and sum(b.num_rows for b in held):
            yield found(pa.Table.from_batches(held))

    return run


def _cut(window: int):
    """Kept words of texts whose repeats are ``spans`` (first window of a run, starts in it, lengths)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = column(batch, "spans")
        of, removed, sha, text = [], [], [], []
        for p in pieces(column(batch, "text_")):
            for i in range(len(p)):
                a, b = int(p.word_at[i]), int(p.word_at[i + 1])
                if not _is(batch, p.first + i, p.text(i)):
                    continue
                step = np.zeros(b - a + 1, np.int64)
                mine = spans[p.first + i].values
                start, length = mine.field("starts"), mine.field("lengths")
                at = np.repeat(mine.field("place").to_numpy(), np.diff(start.offsets.to_numpy())) + start.flatten().to_numpy()
                np.add.at(step, at, 1)
                np.add.at(step, at + length.flatten().to_numpy(), -1)
                gone = np.cumsum(step)[:-1] > 0
                left = b" ".join(w for w, x in zip(p.text(i).split(), gone.tolist()) if not x)
                of.append(p.first + i), removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest()), text.append(left.decode())
        of = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(column(batch, c).take(of) for c in ("h1", "h2")), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())],
            ["h1", "h2", "n_removed", "sha", "kept"],
        )

    return kernel


def _map(kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kernel(batch)

    return run


def _key(words: str) -> Column:
    """128 bits of the SHA-256 of a string."""
    return F.unhex(F.substring(F.sha2(F.col(words), 256), 1, 32))


def _with_text(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the texts of its ids; other texts stay out of the shuffle. Kernels check the words, as an id may repeat."""
    bits, sent = idfilter.bitmap(asked, "id_")
    some = docs.select("id_", "text_", idfilter.slot(bits, F.col("id_"))).mapInArrow(
        idfilter.passing(sent, lambda b: b), f"id_ long, text_ string, {idfilter.SLOT} long"
    )
    some = some.select(F.col("id_").alias("of_"), "text_")
    return some.join(asked, F.col("of_").eqNullSafe(F.col("id_"))).drop("of_", "id_")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = True
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept_text`` (null where no word goes)."""
    spark = df.sparkSession
    stage = Stage(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"))
    survey = docs.mapInArrow(_survey(window, gram), "id_ long, n long, h1 long, h2 long, sha string, anchors array<long>")
    survey = stage.table(survey, "survey")
    classes = stage.table(
        survey.groupBy("h1", "h2").agg(F.min("id_").alias("id_"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("anchors").alias("anchors")), "classes"
    )
    each = classes.where(f"n >= {window}").select("h1", "h2", F.explode("anchors").alias("anchor"))
    twice = stage.table(each.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "twice")
    flagged = stage.table(each.join(twice, "anchor").groupBy("h1", "h2").agg(F.collect_set("anchor").alias("anchors")), "flagged")
    asked = stage.table(classes.select("h1", "h2", "id_", "copies").join(flagged, ["h1", "h2"]), "asked")
    runs = _with_text(docs, asked).mapInArrow(_map(_runs(window, gram)), "h1 long, h2 long, place int, anchor long, words string, alone boolean")
    runs = stage.table(runs.withColumn("key", _key("words")), "runs")
    stage.free("twice", "flagged")
    # Equal runs are combined before they are shuffled, so a passage that a third of all texts share is one row.
    distinct = stage.table(runs.groupBy("anchor", "key", "words").agg(F.count("*").alias("copies")), "distinct")
    large = stage.table(distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(f"c > {MOST_RUNS}").select("anchor"), "large")
    some = not large.isEmpty()
    trees = (distinct.join(large, "anchor", "left_anti") if some else distinct).repartition("anchor").sortWithinPartitions("anchor", "key")
    repeats = trees.select("anchor", "key", "words", "copies").mapInArrow(_subtrees(window), "key binary, starts array<int>, lengths array<int>")
    if some:
        repeats = repeats.union(_whole_windows(distinct.join(large, "anchor", "left_semi"), window, stage))
    repeats = stage.table(repeats, "repeats")
    spans = runs.where("alone").select("h1", "h2", "place", "key").join(repeats, "key")
    spans = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("place", "starts", "lengths")).alias("spans"))
    spans = stage.table(spans.join(asked.select("h1", "h2", "id_"), ["h1", "h2"]), "spans")
    stage.free("runs", "distinct", "large", "repeats")
    cut = _with_text(docs, spans).mapInArrow(_map(_cut(window)), "h1 long, h2 long, n_removed long, sha string, kept string")
    cut = cut if with_text else cut.drop("kept")
    whole = classes.where(f"copies > 1 and n >= {window}")
    whole = whole.select("h1", "h2", F.col("n").alias("n_removed"), F.lit(EMPTY_SHA).alias("sha"), *([F.lit("").alias("kept")] if with_text else []))
    changed = stage.table(cut.union(whole), "changed")
    stage.close(keep=("survey", "changed"))
    out = survey.select("id_", "n", "h1", "h2", "sha").join(changed.withColumnRenamed("sha", "cut_sha"), ["h1", "h2"], "left")
    return out.select(
        F.col("id_").alias(id_col),
        F.col("n").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
        *([F.col("kept").alias("kept_text")] if with_text else []),
    )


def _whole_windows(runs: DataFrame, window: int, stage: Stage) -> DataFrame:
    """Repeats of runs whose subtree is too large for a task: their windows are counted, combined before the shuffle."""
    words = F.split(F.rtrim("words"), " ")
    starts = F.sequence(F.lit(0), F.size("all") - window)
    each = runs.select("key", "copies", words.alias("all")).select("key", "copies", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("all", i + 1, window), " ").alias("w")))).alias("x"))
    each = stage.table(each.select("key", "copies", "x.start", _key("x.w").alias("leaf"), "x.w"), "windows")
    deep = each.groupBy("leaf", "w").agg(F.sum("copies").alias("c")).where("c > 1").select("leaf", "w")
    return each.join(deep, ["leaf", "w"]).groupBy("key").agg(F.sort_array(F.collect_list("start")).alias("starts")).select("key", "starts", F.transform("starts", lambda _: F.lit(window)).alias("lengths"))
