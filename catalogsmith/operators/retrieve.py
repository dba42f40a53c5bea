"""Vector retrieval with metadata filters: cosine and L2, in JVM expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import col


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def _doubles(c: Column | Sequence[float]) -> Column:
    return c.cast("array<double>") if isinstance(c, Column) else F.array(*(F.lit(float(x)) for x in c))


def cosine(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    a, b = _doubles(a), _doubles(b)
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return _sum(F.zip_with(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))


def l2(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def similarity(distance_cosine: Column) -> Column:
    """1 less the cosine distance, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance_cosine))


def cosine_top_k(df: DataFrame, vector: str, query: Sequence[float], key: str, k: int = 2, where: Mapping[str, object] | None = None, least: float | None = None) -> DataFrame:
    """The k most similar rows that match all metadata values."""
    some = df
    for name, value in (where or {}).items():
        some = some.where(col(name) == F.lit(value))
    scored = some.withColumn("similarity", F.round(similarity(cosine(col(vector), query)), 6))
    if least is not None:
        scored = scored.where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def two_tier(df: DataFrame, vector: str, query: Sequence[float], key: str, narrow: Mapping[str, object], wide: Mapping[str, object], k: int = 2, enough: float = 0.70, least: float = 0.45) -> DataFrame:
    """The narrow filter's hits if the best of them is good enough, else the wide filter's; both at least the floor."""
    first = cosine_top_k(df, vector, query, key, k, narrow).withColumn("tier", F.lit(1))
    second = cosine_top_k(df, vector, query, key, k, wide).withColumn("tier", F.lit(2))
    best = F.broadcast(first.agg(F.coalesce(F.max("similarity") >= enough, F.lit(False)).alias("good")))  # a single row
    both = first.unionByName(second).crossJoin(best)
    return both.where(F.when(F.col("good"), F.col("tier") == 1).otherwise(F.col("tier") == 2) & (F.col("similarity") >= least)).drop("good")


def l2_documents(chunks: DataFrame, vector: str, query: Sequence[float], document: str, documents: DataFrame, k: int = 2, candidates: int = 15, limit: float = 1.2) -> DataFrame:
    """Nearest chunks, the best of each document, those within the limit, and the whole documents of the k best."""
    near = chunks.withColumn("distance", F.round(l2(col(vector), query), 6)).orderBy("distance", *[c for c in chunks.columns if c != vector][:1]).limit(candidates)
    best = near.groupBy(document).agg(F.min("distance").alias("distance")).where(F.col("distance") <= limit).orderBy("distance", document).limit(k)
    return best.join(documents, document)


def chunk_table(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """A row per chunk, with its number."""
    from ..functions.text import chunks

    return df.select(key, F.posexplode(chunks(col(text), size, overlap)).alias("chunk", "text"))


def format_hits(hits: DataFrame, key: str, score: str) -> DataFrame:
    return hits.withColumn("line", F.format_string("[%s] %.3f", col(key).cast("string"), col(score)))
