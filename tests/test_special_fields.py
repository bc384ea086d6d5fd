"""Fields with a meaning look for their tag once each."""

from __future__ import annotations

from lumenlake.plans import reports
from lumenlake.sources.schema import TAG


def test_a_tag_is_looked_for_once(spark):
    rows = spark.createDataFrame([], f"tags array<{TAG}>").select(reports.special_fields().alias("s"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("= Orientation)") == 1
