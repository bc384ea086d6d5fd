"""SQL functions that parse only what is asked of them."""

from __future__ import annotations

from lumenlake.functions.register import register
from lumenlake.plans import cases, forged


def test_some_columns_and_tags_of_each_blob(spark, sf_dir):
    register(spark)
    photos = forged.photo_files(spark, sf_dir).where("o < 400").select("o", "content").unionByName(spark.createDataFrame([(1000, None), (1001, b""), (1002, cases.anomaly_photo({"k": 17}))], "o long, content binary"))
    photos.createOrReplaceTempView("photos_in_part")
    ask = "CASE o % 3 WHEN 0 THEN 'width,tags' WHEN 1 THEN 'segments, xmp' END"  # or all
    rows = spark.sql(f"SELECT o, parse_jpeg(content) AS a, parse_jpeg(content, {ask}) AS s, parse_jpeg(content, 'tags', 'IFD0/Model,GPS/GPSLatitude') AS t FROM photos_in_part").collect()
    assert len(rows) > 100
    for r in rows:
        if r["o"] == 1000:
            assert r["a"] is r["s"] is r["t"] is None
            continue
        whole, some = r["a"].asDict(True), r["s"].asDict(True)
        wanted = {0: {"width", "tags"}, 1: {"segments", "xmp"}}.get(r["o"] % 3, set(whole))
        assert some == {k: v if k in wanted else None for k, v in whole.items()}
        assert r["t"].asDict(True)["tags"] == [t for t in whole["tags"] if (t["ifd"], t["tag_name"]) in (("IFD0", "Model"), ("GPS", "GPSLatitude"))]
    tables = [spark.sql(f"SELECT o, t.* FROM photos_in_part, LATERAL jpeg_tags({x}) AS t WHERE t.tag_name = 'Model'").collect() for x in ("content, 'IFD0/Model'", "content")]
    assert sorted(tables[0], key=str) == sorted(tables[1], key=str) and len(tables[0]) > 100
    assert {r["tag_name"] for r in spark.sql("SELECT t.tag_name FROM photos_in_part, LATERAL jpeg_tags(content, 'IFD0/Model') AS t").collect()} == {"Model"}


def test_child_tables_parse_each_blob_once(spark, sf_dir):
    from lumenlake import table_queries

    plan = table_queries.child_tables(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_jpeg(") and "Generate" not in plan and "hashpartitioning" not in plan
