"""Near-duplicate documents by circulant MinHash.

One permutation (sigma) places each shingle on a circle of 2^32 points, a second one (pi) is
shifted around it; the k-th signature coordinate is the least pi over the set shifted by k.
Two permutations thus make all coordinates. Coordinates are banded, and shared bands
propose pairs, which full shingle sets confirm by exact Jaccard similarity, by both of two independent 64-bit hashes.

How large groups stay linear: equal sets collapse to one class before anything is compared.
In a bucket of different sets each is compared with leaders only, the likest of those that its
buckets name. Members of buckets that still hold several components are then compared if
they share a rare shingle: of the shingles that stand in several components, the rarest of two
similar sets must overlap under any common order, so no link is given up, and what a family of
edited copies has in common proposes few pairs. A signature rejects pairs far from similar
before their sets are moved.

Defined results: texts without words, and null texts, link with nothing and are their own
component; rows with the same text share one class, rows that repeat a doc_id are each
judged on their own text and carry that id; an empty table gives an empty result; other
columns are ignored. Ids are cast to long. Very long texts are taken whole; ties do not arise, as every link counts
and the least id names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import idfilter
from lumenlake.llm.columns import unused
from lumenlake.llm.components import components
from lumenlake.llm.store import Stage
from lumenlake.llm.textkit import column, lists, mix32, mix64, pieces, set_keys, shingle_sets

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 5
#: Coordinates of a signature, each kept as four bits in eight longs.
COORDINATES = 128
#: Rounds with leaders, at most; a round is cheap, and each link it finds spares the pairs between what it joins.
PIVOT_ROUNDS = 5
#: Rows of two integers that are broadcast, 16 MB; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def most_differ(percent: int) -> int:
    """Coordinates that may differ: a pair at the threshold has more with a probability of about 1e-6."""
    mean = COORDINATES * (1 - percent / 100) * 15 / 16
    return int(mean + 4.8 * (mean * (1 - mean / COORDINATES)) ** 0.5) + 1


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n coordinates (uint32) of each non-empty set."""
    at = np.cumsum([0, *map(len, sets)])[:-1]
    place = (mix64(np.concatenate(sets) ^ np.uint64(0xA076_1D64_78BD_642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(sets)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(mix32(place + np.uint32(k)), at)
    return out.T


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        x = mix64(x ^ sig[:, r : bands * rows : rows].astype(np.uint64))
    return x.view(np.int64)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each coordinate, sixteen to a long."""
    x = np.zeros((len(sig), COORDINATES // 16), np.uint64)
    for k in range(COORDINATES):
        x[:, k // 16] |= (sig[:, k].astype(np.uint64) & np.uint64(15)) << np.uint64(4 * (k % 16))
    return x.view(np.int64)


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(column(batch, "text_")):
                sets = list(shingle_sets(p, shingle))
                full = [s for s in sets if len(s)]
                sig = signatures([s[:, 0] for s in full], max(COORDINATES, bands * rows)) if full else np.empty((0, max(COORDINATES, bands * rows)), np.uint32)
                some = np.array([len(s) > 0 for s in sets])
                ragged = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(some * x.shape[1])]), pa.int32()), pa.array(x.ravel()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(p.first, len(p)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k if len(s) else None for k, s in zip(set_keys(sets), sets)], pa.binary()),
                        ragged(band_keys(sig, bands, rows)),
                        ragged(nibbles(sig)),
                    ],
                    ["id_", "n", "key", "bands", "sig"],
                )

    return run


def _sets(shingle: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for p in pieces(column(batch, "text_")) for s in shingle_sets(p, shingle)]
        grams, checks = (lists([s[:, k].view(np.int64) for s in sets], pa.int64()) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(set_keys(sets), pa.binary()), grams, checks], ["key", "grams", "checks"])

    return kernel


def _similar(inter: Column, na: Column, nb: Column, percent: int) -> Column:
    return inter * 100 >= (na + nb - inter) * percent


def _differ(a: Column, b: Column) -> Column:
    """Coordinates in which two signatures differ, by their four bits."""

    def one(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((one(a[k], b[k]) for k in range(1, COORDINATES // 16)), one(a[0], b[0]))


def near_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` of each row of ``df``.

    Rows link where 100 * shared >= percent * united shingles. With 24 bands of 5 rows a
    link of similarity 0.85 shares a band with probability 1 - 1e-6, one of 0.8 with 1 - 6e-5;
    raise ``bands`` for more.
    """
    spark = df.sparkSession
    stage = Stage(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    sketch = stage.table(docs.mapInArrow(_sketch(shingle, bands, rows), "id_ long, n long, key binary, bands array<long>, sig array<long>"), "sketch")
    classes = stage.table(
        sketch.where("n > 0").groupBy("key").agg(F.min("id_").alias("id_"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("node"), "key", "id_", "n", "bands", "sig"),
        "classes",
    )
    exploded = classes.select(F.explode("bands").alias("band"), "node")
    shared = stage.table(exploded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "shared")
    members = exploded.join(shared, "band").join(classes.select("node", "n", "sig"), "node")
    buckets = stage.table(members.select("band", "node", "n", "sig"), "buckets")
    comp = _link(docs, classes, buckets, stage, shingle, percent)
    named = classes.join(comp, "node", "left").select("key", "id_", F.coalesce("comp", "node").alias("comp"))
    least = stage.table(named.groupBy("comp").agg(F.min("id_").alias("component_id")), "least")
    by_key = stage.table(named.join(least, "comp").select("key", "component_id"), "by-key")
    stage.close(keep=("sketch", "by-key"))
    out = sketch.select("id_", "n", "key").join(by_key, "key", "left").select("id_", "n", F.coalesce("component_id", "id_").alias("component_id"))
    return out.select(F.col("id_").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id_").eqNullSafe(F.col("component_id")).alias("kept"))


def _link(docs: DataFrame, classes: DataFrame, buckets: DataFrame, stage: Stage, shingle: int, percent: int) -> DataFrame:
    """node, comp of linked classes."""
    wanted = stage.table(classes.select("key", "node", "id_").join(buckets.select("node").distinct(), "node", "left_semi"), "wanted")
    bits, sent = idfilter.bitmap(wanted, "id_")
    kernel = idfilter.passing(sent, _sets(shingle))
    found = docs.select("id_", "text_", idfilter.slot(bits, F.col("id_"))).mapInArrow(kernel, "key binary, grams array<long>, checks array<long>")
    sets = stage.table(found.dropDuplicates(["key"]).join(wanted.select("key", "node"), "key").select("node", "grams", "checks"), "sets")
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent

    def few(rows: DataFrame) -> DataFrame:
        """Narrow rows of a written table, broadcast where they are counted to be few, so that the sets stay where they are."""
        return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        pairs = few(stage.table(pairs, f"{tag}-pairs"))
        right, left = (sets.select(F.col("node").alias(k), F.col("grams").alias(f"g{k}"), F.col("checks").alias(f"c{k}")) for k in "ba")
        both = pairs.join(right, "b").join(left, "a")
        alike = lambda x, y: _similar(F.size(F.array_intersect(x, y)), F.size(x), F.size(y), percent)
        return stage.table(both.where(alike("ga", "gb") & alike("ca", "cb")).select("a", "b"), f"{tag}-edges")

    edges, comp = None, None
    open_ = buckets.withColumn("comp", F.col("node"))
    for k in range(PIVOT_ROUNDS):
        # Each bucket has a leader of its own; each member is compared with the likest leader that it meets.
        order = F.xxhash64("node", "band", F.lit(k))
        lead = stage.table(open_.groupBy("band").agg(*[F.min_by(c, order).alias(f"{c}_p") for c in ("node", "n", "comp", "sig")]), f"lead{k}")
        met = open_.join(lead, "band").where((F.col("comp") != F.col("comp_p")) & near(F.col("n"), F.col("n_p")))
        met = met.withColumn("differ", _differ(F.col("sig"), F.col("sig_p"))).where(F.col("differ") <= most_differ(percent))
        best = met.groupBy("node").agg(F.min_by("node_p", "differ").alias("b"))
        more = confirmed(best.select(F.col("node").alias("a"), "b"), f"lead{k}")
        edges = more if edges is None else edges.union(more)
        comp = components(edges, stage, f"c{k}")
        open_ = stage.table(_unresolved(buckets, comp), f"open{k}")
        if open_.isEmpty():
            return comp
        if more.isEmpty():
            break

    # What is left: members of buckets with several components. Only shingles that stand in several
    # components can be shared across them; among those, ordered by how many sets have them, two
    # similar sets must meet within the first |shared| - least overlap + 1.
    rest = stage.table(open_.select("node", "n", "comp", "sig").dropDuplicates(["node"]), "rest")
    each = sets.join(few(rest.select("node", "comp")), "node").select("node", "comp", F.explode("grams").alias("gram"))
    crossing = each.groupBy("gram").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("gram", "c")
    crossing = stage.table(crossing, "crossing")
    mine = each.select("node", "gram").join(crossing, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("g"))
    s, least = F.size("g"), F.ceil(F.col("n") * percent / 100).cast("int")
    able = mine.join(rest, "node").where(s >= least)
    rare = able.select("node", "n", "comp", "sig", s.alias("s"), F.posexplode(F.slice("g", F.lit(1), s - least + 1)["gram"]).alias("i", "gram"))
    rare = stage.table(rare, "rare")
    a, b = (rare.select("gram", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "comp", "s", "i", "sig")]) for k in "ab")
    # Where this is the first shingle that two sets share, they share at most it and what follows it in both.
    most = F.least(F.col("s_a") - F.col("i_a"), F.col("s_b") - F.col("i_b"))
    possible = near(F.col("n_a"), F.col("n_b")) & _similar(most, F.col("n_a"), F.col("n_b"), percent)
    alike = _differ(F.col("sig_a"), F.col("sig_b")) <= most_differ(percent)
    pairs = a.join(b, "gram").where((F.col("comp_a") < F.col("comp_b")) & possible & alike)
    more = confirmed(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "rare")
    return comp if more.isEmpty() else components(edges.union(more), stage, "c-all")


def _unresolved(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that have several."""
    now = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = now.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    return now.join(several, "band", "left_semi").select("band", "node", "n", "comp", "sig")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of ``df``, the one with the least id; a row that repeats it whole goes too."""
    key, rows = unused(df, "kept_id", "kept_rows")
    kept = near_components(df, id_col, text_col, **options).where("kept").groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias(rows))
    stage = Stage(df.sparkSession)
    kept = stage.table(kept, "kept")
    out = df.join(kept.select(key), F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
    # Only ids that occur more than once cost a comparison of whole rows.
    return out if kept.where(F.col(rows) > 1).isEmpty() else out.dropDuplicates([id_col, text_col])
