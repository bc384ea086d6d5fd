"""Photos that are made and read by one task: two of a row side by side, and findings told by names alone."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from lumenlake.operators import comparison, privacy
from lumenlake.plans import cases, forged
from lumenlake.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sql(name: str, folder) -> list[tuple]:
    return sorted(duckdb.sql(entry.oracle_sql()[name].replace("FROM orders", f"FROM '{folder}/orders.parquet'")).fetchall())


def _repeated(spark, sf_dir, tmp_path) -> str:
    """Orders, some of which come twice or three times."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.union(orders.where("o_orderkey % 3 = 0")).union(orders.where("o_orderkey % 5 = 4")).coalesce(1).write.parquet(f"{tmp_path}/made")
    part = next((tmp_path / "made").glob("*.parquet"))
    part.rename(tmp_path / "orders.parquet")
    return str(tmp_path)


def test_pairs_of_repeated_orders_count_once_each(spark, sf_dir, tmp_path):
    folder = _repeated(spark, sf_dir, tmp_path)
    for name in ("compare_pairs", "compare_summary"):
        assert sorted(map(tuple, entry.queries()[name](spark, folder).collect())) == _sql(name, folder)


def test_pairs_are_not_joined(spark, sf_dir):
    assert "Join" not in _plan(entry.queries()["compare_summary"](spark, sf_dir))
    assert "Exchange" not in _plan(entry.queries()["compare_pairs"](spark, sf_dir)).replace("Exchange RoundRobin", "")


def test_side_by_side_is_the_join_of_both_sides(spark, sf_dir):
    rows = forged.orders(spark, sf_dir)
    sides = {"original": forged.order_photos(), "copy": forged.order_photos(forged.order_copy)}  # every 101st original is cut off
    near = comparison.side_by_side(files.photo_sides(rows, ["o"], sides, comparison.NEEDS), ["o"])
    shots = []
    for x in sides.values():
        made = forged.forged(rows, ["o"], x.make, ["c", "d"]).selectExpr("o", "length AS size_bytes", "sha2(content, 256) AS sha256", "content")
        shots.append(comparison.snapshots(files.photos(made, ["o", "size_bytes", "sha256"], columns=comparison.NEEDS), ["o"]))
    far = comparison.compare(*shots, ["o"])
    names = ["o", "original", "copy", "identical_files", "changes", "recompression"]
    assert near.select(names).orderBy("o").collect() == far.select(names).orderBy("o").collect()
    levels = comparison.levels(files.photo_sides(rows, ["o"], sides, comparison.CODING_NEEDS)).select("o", "level")
    assert levels.orderBy("o").collect() == far.selectExpr("o", "recompression.level").orderBy("o").collect()


def test_names_alone_tell_of_all_findings(spark, sf_dir):
    codes = set()
    for make in (cases.private_photo, cases.packet_photo):
        blobs = cases.files(spark, sf_dir, make)
        rows = privacy.judge(privacy.assess(files.photos(blobs, ["k"], columns={*privacy.NEEDS, *privacy.FOUND_NEEDS})).withColumnRenamed("points", "points_").withColumnRenamed("level", "level_"))
        told = rows.select("findings.code", "found", "points", "level", "points_", "level_").collect()
        codes |= {c for r in told for c in r["code"] or ()}
        for r in told:
            assert (None if r["found"] is None else {k for k, v in r["found"].asDict().items() if v}) == (None if r["code"] is None else set(r["code"]))
            assert (r["points"], r["level"]) == (r["points_"], r["level_"])
    assert codes == privacy.CODES


def test_photos_of_scores_stay_in_their_task(spark, sf_dir):
    plan = _plan(entry.queries()["text_scores"](spark, sf_dir))
    assert plan.count("MapInArrow") == 1 and "content" not in plan
