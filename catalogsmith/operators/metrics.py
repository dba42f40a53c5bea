"""Evaluation metrics of mappings, recoveries and runs, as joins and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapping_metrics(proposed: DataFrame, expected: DataFrame, header: DataFrame, critical: DataFrame) -> DataFrame:
    """One row: header fidelity, critical coverage, expected-mapping accuracy and forbidden-free share. Tables of (left, replace);
    header (column); critical (field)."""
    parts = proposed.select("left", F.explode(F.split("left", r"\+")).alias("part"))
    known = parts.join(header, F.trim("part") == F.col("column"), "left").agg(F.round(F.avg(F.col("column").isNotNull().cast("int")), 4).alias("header_fidelity"))
    covered = critical.join(proposed.select("replace").distinct(), F.col("field") == F.col("replace"), "left").agg(F.round(F.avg(F.col("replace").isNotNull().cast("int")), 4).alias("critical_coverage"))
    right = expected.alias("e").join(proposed.distinct().alias("p"), F.expr("e.left = p.left and e.replace = p.replace"), "left").agg(F.round(F.avg(F.col("p.left").isNotNull().cast("int")), 4).alias("mapping_accuracy"))
    return known.crossJoin(covered).crossJoin(right)  # three single rows


def escalation_matrix(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Cases by whether a person should and did decide: correct_auto, correct_escalation, over_caution or missed_escalation."""
    label = F.when(expected & actual, "correct_escalation").when(~expected & ~actual, "correct_auto").when(actual, "over_caution").otherwise("missed_escalation")
    return df.groupBy(label.alias("outcome")).agg(F.count("*").alias("n"))


def never_grows(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """A row per step: its rows, and whether they are no more than those of the step before."""
    from pyspark.sql import Window

    counts = None
    for i, (name, df) in enumerate(steps):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    before = F.lag("rows").over(Window.orderBy("step"))
    return counts.withColumn("ok", F.coalesce(F.col("rows") <= before, F.lit(True)))


def split_rate(column: Column, pattern: str) -> Column:
    """The share of values that a pattern parts into two or more: an aggregate."""
    return F.round(F.avg((F.size(F.filter(F.split(column, pattern), lambda x: x != "")) > 1).cast("int")), 4)


def _share(df: DataFrame, on: Column, name: str) -> DataFrame:
    """One row: the share of rows for which on holds; 1 for no rows."""
    return df.agg(F.coalesce(F.round(F.avg(F.coalesce(on, F.lit(False)).cast("int")), 4), F.lit(1.0)).alias(name))


def schema_adherence(proposed: DataFrame, fields: DataFrame) -> DataFrame:
    """The share of non-empty targets (replace) that are fields of the schema (field)."""
    rows = proposed.where(F.trim("replace") != "").join(fields.distinct(), F.col("replace") == F.col("field"), "left")
    return _share(rows, F.col("field").isNotNull(), "schema_adherence")


def target_conformance(proposed: DataFrame, catalog: DataFrame) -> DataFrame:
    """The share of target names whose base name is in the catalog (field, allow_lang), with a language only where it allows one."""
    base = F.regexp_extract("replace", r"^([a-zA-Z0-9._-]+)(?:\[([a-zA-Z]{2})\])?$", 1)
    lang = F.regexp_extract("replace", r"^([a-zA-Z0-9._-]+)(?:\[([a-zA-Z]{2})\])?$", 2)
    rows = proposed.select(base.alias("base"), lang.alias("lang")).join(catalog, F.col("base") == F.col("field"), "left")
    return _share(rows, F.col("field").isNotNull() & ((F.col("lang") == "") | F.col("allow_lang")), "target_conformance")


def core_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """The share of distinct sources (left) of one mapping that another still uses."""
    old, new = before.select(F.col("left").alias("was")).distinct(), after.select(F.col("left").alias("still")).distinct()
    return _share(old.join(new, F.col("was") == F.col("still"), "left"), F.col("still").isNotNull(), "core_preservation")


def forbidden_absence(proposed: DataFrame, forbidden: DataFrame) -> DataFrame:
    """The share of forbidden names (field) that no mapping targets."""
    used = proposed.select("replace").distinct()
    return _share(forbidden.join(used, F.col("field") == F.col("replace"), "left"), F.col("replace").isNull(), "forbidden_absence")


def cell_preservation(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The share of non-empty cells of some fields that a step left as they were; a lost row loses all its cells."""
    old = before.select(F.col(key).alias("k"), F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("f", "v")).where("v <> ''")
    new = after.select(F.col(key).alias("k2"), F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("f2", "v2"))
    return _share(old.join(new, (F.col("k") == F.col("k2")) & (F.col("f") == F.col("f2")), "left"), F.col("v") == F.col("v2"), "cell_preservation")


def agreement(df: DataFrame, expected: Column, actual: Column, name: str = "agreement") -> DataFrame:
    """The share of cases in which what was done (a strategy, column, action or tool) is what was expected; two nulls agree."""
    return _share(df, expected.eqNullSafe(actual), name)


def calibration(df: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence and accuracy: whether a stated confidence (0 to 1) is kept."""
    which = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 4).alias("confidence"), F.round(F.avg(right.cast("int")), 4).alias("accuracy"))


def token_exactness(values: DataFrame, column: str, pattern: str, expected: str) -> DataFrame:
    """The share of values that a pattern parts into exactly the tokens listed in the array column expected."""
    tokens = F.filter(F.transform(F.split(column, pattern), lambda x: F.trim(x)), lambda x: x != "")
    return _share(values, tokens == F.col(expected), "token_exactness")


def tool_selection(expected: Column, forbidden: Column, used: Column) -> Column:
    """Whether the tools used (arrays) are right: none where none is expected, else all the expected ones and no forbidden one."""
    return F.when(F.size(expected) == 0, F.size(used) == 0).otherwise((F.size(F.array_except(expected, used)) == 0) & ~F.arrays_overlap(forbidden, used))
