"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in an order that their ids fix, form blocks. Time is a sequence of slots,
one block each. With integer weights w of total W, block j of a source is released at
floor(j * W / w) and due at ceil((j + 1) * W / w); earliest-deadline-first over released
blocks meets all deadlines, so at any slot each source is within one block of its weight's
share. The schedule repeats after W slots, so one period is computed, and the slot of any
block follows from its number by arithmetic: nothing is simulated per row.

When a source runs out, the others go on at their weights in a new phase, so no row is
dropped: there are at most as many phases as sources. Of a phase only the slots it has are computed,
at most one period, so the plan never holds more slots than there are blocks; it goes out in parts.

Ranks within a source come from counts of (source, hash prefix) cells and a window inside a
cell, never from a window over a source; the number of cells follows the number of rows. What
reaches the driver is one row per source; what is broadcast is one part
of the plan.

Defined results: a null source is a source of its own; a source without a stated weight has
``default_weight``; repeated rows are each scheduled, in any order among themselves; an
empty table gives an empty result; ``position`` has no gaps; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.columns import unused
from lumenlake.llm.store import Stage

BLOCK = 16
#: Slots in a period, and sources: stated bounds of what the driver holds. Beyond them sources must be grouped
#: or weights made coarser.
MOST_WEIGHT, MOST_SOURCES = 1_000_000, 5_000
#: Slots of the phases that are sent out at once; a longer plan goes out in parts.
PLAN_PART = 1_000_000
#: Mean rows of a rank cell, aimed at.
CELL_ROWS = 2_000


def period(weights: list[int], blocks: list[int] | None = None) -> list[int]:
    """The source of each slot of one period, earliest deadline first among released blocks.

    With ``blocks``, it ends with the last block of the source that runs out first, if that comes before the period's end.
    """
    total, out = sum(weights), []
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        _, i, j = heapq.heappop(ready)
        out.append(i)
        if blocks and j + 1 == blocks[i]:
            return out
        if j + 1 < weights[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
    return out


def phases(blocks: list[int], weights: list[int]) -> Iterator[tuple[list[tuple[int, int, int, int, int, list[int]]], int]]:
    """Of each phase its sources as (source, first block, end block, first slot, period length, slots of its blocks in a period), and the source that runs out.

    Only the slots that the phase has are computed, at most one period of weights without common divisor:
    over all phases no more than there are blocks.
    """
    done, slot = [0] * len(blocks), 0
    live = [i for i, n in enumerate(blocks) if n]
    while live:
        common = gcd(*(weights[i] for i in live))
        w = [weights[i] // common for i in live]
        order = period(w, [blocks[i] - done[i] for i in live])
        own: dict[int, list[int]] = {}
        for t, k in enumerate(order):
            own.setdefault(k, []).append(t)
        # The phase ends with the last block of the source that runs out first.
        ends = []
        for k, slots in own.items():
            left = blocks[live[k]] - done[live[k]] - 1
            if len(slots) == w[k] or left < len(slots):
                ends.append((left // len(slots) * len(order) + slots[left % len(slots)] + 1, live[k]))
        end, out = min(ends)
        whole, rest = divmod(end, len(order))
        rows = []
        for k, slots in own.items():
            i, n = live[k], whole * len(slots) + bisect_left(slots, rest)
            if n:
                rows.append((i, done[i], done[i] + n, slot, len(order), slots))
                done[i] += n
        yield rows, out
        slot += end
        live.remove(out)


def schedule(
    df: DataFrame, weights: Mapping[str | None, int] | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK, default_weight: int = 1
) -> DataFrame:
    """``id_col``, ``source_col``, ``block_no`` (in its source), ``slot`` and ``position`` (0, 1, 2 ... over all) of each row."""
    spark = df.sparkSession
    stage = Stage(spark)
    weights = dict(weights or {})
    rows = stage.table(
        df.select(F.col(source_col).alias("src_"), F.col(id_col).alias("id_"))
        .select("*", F.md5(F.coalesce(F.col("id_").cast("string"), F.lit(""))).alias("key_")),
        "mix-rows",
    )
    sizes = rows.groupBy("src_").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    sizes.sort(key=lambda r: (r["src_"] is not None, str(r["src_"])))
    w = [int(weights.get(r["src_"], default_weight)) for r in sizes]
    if len(sizes) > MOST_SOURCES or sum(w) > MOST_WEIGHT or any(x < 1 for x in w):
        raise ValueError(f"weights must be positive, at most {MOST_WEIGHT} together, for at most {MOST_SOURCES} sources")
    hexes = max(1, min(8, -(-max(1, sum(r["n"] for r in sizes) // CELL_ROWS).bit_length() // 4)))

    # Rank of a row in its source: rows in earlier cells, plus rows before it in its cell.
    rows = rows.withColumn("cell_", F.substring("key_", 1, hexes))
    cells = stage.table(rows.groupBy("src_", "cell_").agg(F.count("*").alias("m")), "mix-cells")
    before = _running(cells, ["src_"], "cell_", "m", stage)
    inside = F.row_number().over(Window.partitionBy("src_", "cell_").orderBy("key_", "id_"))
    ranked = rows.withColumn("in_", inside).join(
        before.select(F.col("src_").alias("s_"), F.col("cell_").alias("c_"), "before"), F.col("src_").eqNullSafe(F.col("s_")) & (F.col("cell_") == F.col("c_"))
    )
    ranked = ranked.select("src_", "id_", (F.col("before") + F.col("in_") - 1).alias("rank_")).withColumn("block_no", F.floor(F.col("rank_") / block))

    # Rows missing before a phase: all blocks are full but the last of each source, which ends its phase.
    kind = f"s_ {df.schema[source_col].dataType.simpleString()}, b0 long, b1 long, slot0 long, every long, slots array<long>, holes long"
    k = F.col("block_no") - F.col("b0")
    slot = F.col("slot0") + F.floor(k / F.size("slots")) * F.col("every") + F.element_at("slots", (k % F.size("slots") + 1).cast("int"))
    path, schema, staged = stage.new("mix-placed"), None, False
    for part, last in _parts(sizes, w, block):
        if not (last or staged):
            ranked, staged = stage.table(ranked, "mix-ranked"), True
        phase = F.broadcast(spark.createDataFrame(part, kind))
        placed = ranked.join(phase, F.col("src_").eqNullSafe(F.col("s_")) & (F.col("block_no") >= F.col("b0")) & (F.col("block_no") < F.col("b1")))
        placed = placed.select("src_", "id_", "block_no", "rank_", slot.alias("slot"), "holes")
        placed.write.mode("append").option("compression", "zstd").parquet(path)
        schema = placed.schema
    placed = spark.read.schema(schema).parquet(path)
    stage.close(keep=("mix-placed",))
    return placed.select(
        F.col("id_").alias(id_col),
        F.col("src_").alias(source_col),
        F.col("block_no").cast("long").alias("block_no"),
        F.col("slot").cast("long").alias("slot"),
        (F.col("slot") * block + F.col("rank_") % block - F.col("holes")).cast("long").alias("position"),
    )


def _parts(sizes: list, weights: list[int], block: int) -> Iterator[tuple[list[tuple], bool]]:
    """The plan's rows (source, first block, end block, first slot, period length, slots, rows missing before), about PLAN_PART slots at a time, and whether they are the last."""
    part, held, holes = [], 0, 0
    for rows, out in phases([-(-r["n"] // block) for r in sizes], weights):
        if held >= PLAN_PART:
            yield part, False
            part, held = [], 0
        part += [(sizes[i]["src_"], *row, holes) for i, *row in rows]
        held += sum(len(row[-1]) for row in rows)
        holes += -sizes[out]["n"] % block
    yield part, True


def mixed(df: DataFrame, weights: Mapping[str | None, int] | None = None, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """All rows and columns of ``df``, sorted by ``position``.

    Rows that repeat an id are told apart by numbers that are fixed by writing them, and are scheduled by those.
    """
    names = df.columns
    key, at_, own = unused(df, "mix_key", "mix_at", "mix_no")
    if not df.select(F.col(id_col).alias("id")).groupBy("id").count().where("count > 1").isEmpty():
        df = Stage(df.sparkSession).table(df.withColumn(own, F.monotonically_increasing_id()), "mix-numbered")
        id_col = own
    at = schedule(df, weights, source_col, id_col, **options).select(F.col(id_col).alias(key), F.col("position").alias(at_))
    # A sorted merge at every size: neither side is bounded, so none is broadcast because it happens to be small.
    return df.join(at.hint("merge"), F.col(id_col).eqNullSafe(F.col(key))).orderBy(at_).select(*names)


def _running(cells: DataFrame, group: list[str], order: str, count: str, stage: Stage) -> DataFrame:
    """Rows in earlier cells of the group, as ``before``; in two levels, so no window holds a source's every cell."""
    top = F.substring(order, 1, 4)
    coarse = cells.groupBy(*group, top.alias("top_")).agg(F.sum(count).alias("t_"))
    above = stage.table(coarse.withColumn("above_", F.coalesce(F.sum("t_").over(Window.partitionBy(*group).orderBy("top_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "mix-coarse")
    fine = cells.withColumn("top_", top).withColumn(
        "fine_", F.coalesce(F.sum(count).over(Window.partitionBy(*group, "top_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    on = [F.col(g).eqNullSafe(F.col(f"g{i}")) for i, g in enumerate(group)]
    keyed = above.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col("top_").alias("t2_"), "above_")
    joined = fine.join(keyed, [*on, F.col("top_") == F.col("t2_")])
    return joined.select(*group, order, (F.col("above_") + F.col("fine_")).alias("before"))


__all__ = ["schedule", "mixed", "period", "phases"]
