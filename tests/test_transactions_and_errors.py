"""Transactions that fail in executors, key discovery, and the context of errors."""

import os
import re

import pytest
from pyspark.sql import functions as F

from catalogsmith.functions import errors
from catalogsmith.operators import join, transaction, validate
from catalogsmith.plans import pipeline


def _versions(folder):
    return [d for d in os.listdir(folder)] if os.path.isdir(folder) else []


def test_sound_changes_are_committed(spark, tmp_path):
    df = spark.createDataFrame([(f" k{i} ", f"v{i}") for i in range(500)] + [("", "blank")], "id string, v string").repartition(4)
    before = transaction.write(df, str(tmp_path), "id")
    assert (before.rows, before.blanks) == (501, 1)
    after = transaction.write(before.table.withColumn("id", F.trim("id")).orderBy("v"), str(tmp_path), "id")
    assert after.digest == before.digest and transaction.sound(before, after)  # keys are compared without the white space around them
    lost = transaction.write(before.table.where("v != 'v7'"), str(tmp_path), "id")
    assert not transaction.sound(before, lost) and transaction.lost_keys(before, lost) == 1
    swapped = transaction.write(before.table.withColumn("id", F.when(F.col("v") == "v7", "other").otherwise(F.col("id"))), str(tmp_path), "id")
    assert swapped.rows == before.rows and not transaction.sound(before, swapped)
    assert transaction.report(before, lost).first().asDict() == {"rows_before": 501, "rows_after": 500, "lost_ids": 1, "lost_columns": 0, "valid": False}
    assert not transaction.sound(before, transaction.write(before.table.drop("v"), str(tmp_path), "id"))
    none = transaction.write(df.where("false"), str(tmp_path), "id")
    assert none.rows == 0 and transaction.sound(none, none)


def test_a_change_that_an_executor_fails_is_tried_again(spark, tmp_path):
    flag = str(tmp_path / "failed")
    before = transaction.write(spark.range(100).withColumn("id", F.col("id").cast("string")), str(tmp_path / "t"), "id")

    def change(df):
        @F.udf("string")
        def once(v):
            if v == "42" and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("an executor is gone")
            return v + "!"

        return df.withColumn("x", once("id"))

    done = transaction.transact(before, [change], str(tmp_path / "t"))
    assert done.committed and len(done.errors) == 1 and done.version.table.where("x = '42!'").count() == 1
    gone = transaction.transact(before, [lambda df: df.limit(3), lambda df: df.where(F.raise_error(F.lit("never")).isNull())], str(tmp_path / "t"))
    assert not gone.committed and gone.version is before and len(gone.errors) == 2
    assert len(_versions(tmp_path / "t")) == 2  # the two that stand


def test_a_step_that_fails_at_run_time_is_repaired_and_tried_again(spark, tmp_path):
    schema = "id string, title string, author string, date string, type string, doi string"
    source = spark.createDataFrame([(f"s{i}", f"Study number {i} of things", "Perez, Ana", "bad" if i == 3 else "2001", "Articulo", "") for i in range(8)], schema)
    repository = spark.createDataFrame([("r1", "Study number 1 of things", "Perez, Ana", "2001", "Articulo", "")], schema)
    plain = join.duplicate_edges
    tried = []

    def failing(a, b, *rest):
        out = plain(a, b, *rest)
        tried.append(1)
        return out if len(tried) > 1 else out.withColumn("similarity", F.when(F.col("similarity") >= 0, F.raise_error(F.lit("in an executor")).cast("double")).otherwise(F.col("similarity")))

    params = pipeline.PipelineParams(folder=str(tmp_path), repairs=[("type", "value_mapping", {"values": {"Articulo": "Article"}})])
    pipeline.join.duplicate_edges = failing
    try:
        done = pipeline.run(source, repository, params, until="reconcile")
    finally:
        pipeline.join.duplicate_edges = plain
    assert len(tried) == 2 and any("tried again" in w for w in done.warnings)
    assert {r.type for r in done.tables["records"].select("type").distinct().collect()} == {"Article"}
    assert done.versions["reconciled"].rows == done.tables["reconciled"].count() < done.versions["records"].rows
    want = pipeline.run(source, repository, pipeline.PipelineParams(), until="reconcile").tables["reconciled"]
    assert {r.id for r in done.tables["reconciled"].collect()} == {r.id for r in want.collect()}


def test_keys_are_told_from_sketches(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("record_id"), F.floor(F.col("id") / 2).alias("half_id"), (F.col("id") - F.when(F.col("id") == 7, 1).otherwise(0)).alias("near_id"), F.when(F.col("id") != 5, F.col("id")).alias("null_id"), F.lit("x").alias("title"))
    found = {r.column: r for r in validate.key_test(df, df.columns).collect()}
    assert {c for c, r in found.items() if r.is_key} == {"record_id"}
    assert found["near_id"].exact and found["near_id"].distinct_values == 29_999 and not found["half_id"].exact and abs(found["half_id"].distinct_values - 15_000) < 600
    assert validate.discover_key(df) == "record_id" and validate.discover_key(df.drop("record_id")) is None
    keyed, name = validate.keyed_table(df.drop("record_id").withColumn("o", F.monotonically_increasing_id()), "o")
    assert name == "id" and keyed.select("id").distinct().count() == 30_000
    assert validate.discover_key(df.where("false")) is None and validate.key_test(df, []).count() == 0
    plan = df.agg(*[F.hll_sketch_agg(c) for c in ("record_id", "half_id")])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


MESSAGES = [
    "ValueError: could not convert 'La Plata' to float", 'KeyError: "nowhere" in \'quito\'', "bad month 'Enero'", "the año is odd", "no AUTOR", "Titulo missing", "nothing", "", None,
    "two ' spaces ' and 'x'", "TypeError 'zz' and then \"Perez\"", f"'{'long' * 20}'", "fecha 'La Plata'",
]
TABLE = [(1, "a1", "", "Perez, Ana"), (2, None, "La Plata", "x"), (3, "QUITO", "La Plata", "Perez"), *((i, "a", "b", "c") for i in range(4, 60)), (60, "zz", "zz", "zz")]


def _plain(message):
    message = message or ""
    found = re.search(r"\b([A-Z][a-zA-Z]+Error)\b", message)
    words = [w.strip() for w in re.findall(r"""['"]([^'"]+)['"]""", message)]
    words = [w for w in words if w and len(w) < 50]
    for row in sorted(TABLE)[:49]:
        for name, value in zip(("id", "place", "author"), row[1:]):
            if value and any(w.lower() in value.lower() for w in words):
                return found[1] if found else "UnknownError", words, name
    low = message.lower()
    column = "date" if any(w in low for w in errors.KEYWORDS["date"]) or any(w.lower() in errors.MONTHS for w in words) else "author" if any(w in low for w in errors.KEYWORDS["author"]) else "title" if any(w in low for w in errors.KEYWORDS["title"]) else ""
    return found[1] if found else "UnknownError", words, column


def test_error_context(spark):
    table = spark.createDataFrame(TABLE, "n long, id string, place string, author string").repartition(3)
    messages = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "i int, message string")
    got = {r.i: (r.error_class, r.sample_tokens, r.affected_column) for r in errors.error_context(messages, "message", table, order_by="n").collect()}
    assert got == {i: _plain(m) for i, m in enumerate(MESSAGES)}
    assert {r.affected_column for r in errors.error_context(messages.where("i = 0"), "message").collect()} == {""}
