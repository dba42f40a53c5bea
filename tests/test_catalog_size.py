"""Guardrails with a target catalog of any size."""

from catalogsmith.operators import crosswalk


def test_catalog_of_any_size(spark):
    catalog = spark.range(0, 25_000, 1, 4).selectExpr("concat('dc.f', id) as field", "true as allow_lang")
    mappings = spark.createDataFrame([(i, "a", f"dc.f{i}") for i in range(0, 25_000, 1000)], "pos long, left string, replace string")
    header = spark.createDataFrame([("a",)], "column string")
    assert {r.action for r in crosswalk.guard_target(mappings, catalog).collect()} == {"kept"}
    assert {r.status for r in crosswalk.compatibility(mappings, header, catalog).collect()} == {"valid"}
