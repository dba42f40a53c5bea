"""The sanitizer before deduplication: seven ordered rules, a log of what they changed, and a quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import col, is_blank, ws_trim


@dataclass(frozen=True)
class Sanitized:
    records: DataFrame
    quarantine: DataFrame
    log: DataFrame


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Ids trimmed and filled, dates and types cleaned or inferred, author defaulted; row-local, so it also runs on streams."""
    have = set(df.columns)
    field = lambda f: col(f) if f in have else F.lit("")
    out = {"id": F.when(is_blank(col("id")), F.concat(F.lit("item_"), F.col("_row_id") + 1)).otherwise(ws_trim(col("id")))} if {"id", "_row_id"} <= have else {}
    if "date" in have:
        out["date"] = t.infer_date(col("date"), field("citation"), field("title"), field("description"))
    if "type" in have:
        out["type"] = t.infer_type(col("type"), field("issn"), field("isbn"), field("citation"), field("title"))
    if "author" in have:
        out["author"] = t.default_author(col("author"))
    return df.withColumns(out)


def quarantine_reason() -> Column:
    """Why a record can't go on: a blank date, type, or both; null if it can."""
    date, type_ = is_blank(col("date")), is_blank(col("type"))
    return F.when(date & type_, "missing date and type").when(date, "missing date").when(type_, "missing type")


def change_log(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], stage: str) -> DataFrame:
    """stage, column, row_id, original and cleaned of each changed cell. before and after are row-aligned by key."""
    both = before.select(key, *(col(f).cast("string").alias(f"b_{f}") for f in fields)).join(after.select(key, *(col(f).cast("string").alias(f"a_{f}") for f in fields)), key)
    return _unpivot(both, key, fields, stage)


def _unpivot(both: DataFrame, key: str, fields: Sequence[str], stage: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("column"), F.coalesce(F.col(f"b_{f}"), F.lit("")).alias("original"), F.coalesce(F.col(f"a_{f}"), F.lit("")).alias("cleaned")) for f in fields))
    changed = F.filter(cells, lambda x: x["original"] != x["cleaned"])
    return both.select(F.col(key).alias("row_id"), F.explode(changed).alias("x")).select(F.lit(stage).alias("stage"), "x.column", "row_id", "x.original", "x.cleaned")


def sanitize(df: DataFrame, key: str = "_row_id") -> Sanitized:
    """Records, quarantine and log. Old and new cells stand in one row, so the log needs no join."""
    fields = [f for f in ("id", "date", "type", "author") if f in df.columns]
    both = sanitize_columns(df.withColumns({f"b_{f}": col(f).cast("string") for f in fields}))
    log = _unpivot(both.withColumns({f"a_{f}": col(f) for f in fields}), key, fields, "sanitizer")
    clean = both.drop(*(f"b_{f}" for f in fields)).withColumn("quarantine_reason", quarantine_reason())
    return Sanitized(_those(clean, F.col("quarantine_reason").isNull()).drop("quarantine_reason"), _those(clean, F.col("quarantine_reason").isNotNull()), log)


def _those(df: DataFrame, on: Column) -> DataFrame:
    """Rows for which on holds. A filter would be moved below the rules, and so hold all of them once more; a generator stays."""
    row = F.struct(*(col(c) for c in df.columns))
    return df.select(F.explode(F.when(on, F.array(row))).alias("x")).select("x.*")


def fail_if_nothing_left(records: DataFrame) -> DataFrame:
    if records.isEmpty():
        raise ValueError("all records are in quarantine")
    return records

