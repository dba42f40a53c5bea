"""Bounded samples of labelled texts, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparkio import keyed, quoted


def labelled_texts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: dict[int, int], chars: int, allowed: Column | None = None) -> list[tuple[int, str]]:
    """(label, text), at most about most[label] of each label, of texts up to chars code points, by a hash of the id. Of a
    document with two labels the greater counts, of an id with several texts the least, so repeated rows change nothing. Only the
    chosen ids, at most twice the sum of most, are broadcast, and a text for each of them is gathered."""
    rows = labels.where(allowed) if allowed is not None else labels
    rows = rows.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("int").alias("label")).dropna()
    rows = rows.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    counts = {r.label: r["count"] for r in rows.where(F.col("label").isin(*most)).groupBy("label").count().collect()}
    limit = F.lit(None).cast("long")
    for value, n in most.items():
        share = min(1.0, n / max(counts.get(value, 0), 1))
        limit = F.when(F.col("label") == value, F.lit(int((share - 0.5) * 1.9999 * 2**63))).otherwise(limit)
    chosen = rows.where(F.col("h") <= limit).orderBy("h").limit(2 * sum(most.values()))
    texts = keyed(df, id_col, text_col).where(F.length("text") <= chars).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    one = texts.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text"))
    return [(label, text) for _, label, text in sorted((r.h, r.label, r.text) for r in one.collect())]
