"""Counts, best-of groups, paging and quality ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR_PATTERNS, SEPARATORS
from ..schema import col, is_blank, ws_trim


def best_per_group(df: DataFrame, group: str, score: str, least: bool = True) -> DataFrame:
    return df.groupBy(group).agg((F.min if least else F.max)(score).alias(score))


def merge_hits(hits: Sequence[DataFrame], key: str = "chunk_id", score: str = "score") -> DataFrame:
    """Hits of several back-ends: one row per key, with the values of its best score."""
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h, allowMissingColumns=True)
    others = [c for c in both.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(score, *(c for c in others if c != score)))
    return both.groupBy(key).agg(best.alias("x")).select(key, *(F.col("x")[c].alias(c) for c in others))


def top_k(df: DataFrame, score: str, tie: str, k: int, ascending: bool = True, limit: float | None = None) -> DataFrame:
    """The k best by score and tie, of those within the limit: a bounded heap in each task."""
    some = df if limit is None else df.where(F.col(score) <= limit if ascending else F.col(score) >= limit)
    return some.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), tie).limit(k)


def page_of(df: DataFrame, order: Sequence[str], page: int, size: int, cap: int = 1000) -> DataFrame:
    size = min(size, cap)
    return df.orderBy(*order).offset(page * size).limit(size)


def keyset_page(df: DataFrame, key: str, after: object, size: int, cap: int = 1000) -> DataFrame:
    """The page after a key: unlike an offset it reads no earlier page."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(min(size, cap))


def page_totals(df: DataFrame, size: int) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total_elements"), F.ceil(n / size).cast("long").alias("total_pages"))


def filled_ratios(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The share of rows with a value, for each field, in one pass."""
    return df.agg(*(F.round(F.avg((~is_blank(col(f))).cast("int")), 4).alias(f"filled_{f}") for f in fields))


def precision_recall(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)
    counts = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return counts.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def z_scores(df: DataFrame, value: str) -> DataFrame:
    """The distance of each value from the mean in sample deviations; the two figures are one broadcast row, not a global window."""
    one = df.agg(F.avg(value).alias("__m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return df.crossJoin(F.broadcast(one)).withColumn("z", F.round(z, 4)).drop("__m", "__s")


def biased_head(df: DataFrame, column: str, order: str, n: int = 5, least: int = 35, width: int = 100) -> DataFrame:
    """n rows, those with a long value first, then in order; all values cut to width (a preview by design)."""
    prio = F.when(F.length(col(column)) >= least, 0).otherwise(1)
    head = df.withColumn("__prio", prio).orderBy("__prio", order).limit(n).drop("__prio")
    return head.select(*(F.substring(col(c).cast("string"), 1, width).alias(c) for c in df.columns))


def column_samples(df: DataFrame, order: str, columns: Sequence[str], n: int = 3, width: int = 30) -> DataFrame:
    """column and position of its first n non-empty values. The limit on row_number applies within tasks before the shuffle."""
    cells = df.select(order, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(order, "x.*").where(~is_blank(F.col("value")))
    w = Window.partitionBy("column").orderBy(order)
    return cells.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("column", "pos", F.substring("value", 1, width).alias("value"))


def detect_separator(df: DataFrame, column: str, order_by: str, patterns: Sequence[str] = ()) -> DataFrame:
    """One row, type (literal, regex or unknown) and value: of the first non-blank value in the order of order_by, the first
    candidate that parts it into two or more; patterns are tried after the known ones."""
    value = ws_trim(col(column).cast("string"))
    first = df.where(value != "").agg(F.min_by(col(column).cast("string"), col(order_by)).alias("v"))
    parts = lambda by: F.size(F.filter(F.split("v", by), lambda x: ws_trim(x) != "")) > 1
    found = [F.when(parts("\\Q" + s + "\\E"), F.struct(F.lit("literal").alias("type"), F.lit(s).alias("value"))) for s in SEPARATORS]
    found += [F.when(parts(p), F.struct(F.lit("regex").alias("type"), F.lit(p).alias("value"))) for p in (*SEPARATOR_PATTERNS, *patterns)]
    return first.select(F.coalesce(*found, F.struct(F.lit("unknown").alias("type"), F.lit("").alias("value"))).alias("x")).select("x.type", "x.value")


def separator_shares(df: DataFrame, column: str, patterns: Sequence[str] = (), literal: float = 0.8, regex: float = 0.6) -> DataFrame:
    """separator, type, share and chosen for all candidates in one pass over the non-blank values: the share that holds a literal,
    or that a pattern parts; chosen where it is over literal or regex."""
    value = col(column).cast("string")
    kinds = [(s, "literal", value.contains(s), literal) for s in SEPARATORS] + [(p, "regex", F.size(F.filter(F.split(value, p), lambda x: ws_trim(x) != "")) > 1, regex) for p in patterns]
    one = df.where(ws_trim(value) != "").agg(*(F.avg(on.cast("int")).alias(f"s{i}") for i, (_, _, on, _) in enumerate(kinds)))
    rows = [F.struct(F.lit(s).alias("separator"), F.lit(kind).alias("type"), F.round(f"s{i}", 4).alias("share"), F.coalesce(F.col(f"s{i}") > least, F.lit(False)).alias("chosen")) for i, (s, kind, _, least) in enumerate(kinds)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
