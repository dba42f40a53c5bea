"""Search by relevance: an inverted index with term frequencies, scored by BM25.

The index is a table of postings, (term, key, tf, length), and one row of statistics. Written, it is partitioned by a hash of the
term and sorted by term within each file, so that a search reads the buckets of its terms and of these the row groups that hold
them. A search joins its few terms to the postings, so its work follows the postings of its terms and not the catalog. An index
that is searched without being written makes postings of the asked terms only; its rows are dealt by key once, so that counting a
row's terms, and adding up its score for each query, needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import col

BUCKETS = 64


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null text: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class TextIndex:
    """postings: term, key, tf, length (tokens of the row), bucket; totals: one row of rows and tokens. Rows without a token count
    among the rows. words, of an index that is not stored: key, length and term of every token, dealt by key."""

    postings: DataFrame
    totals: DataFrame
    words: DataFrame | None = None

    def held(self, wanted: DataFrame) -> DataFrame:
        """The postings of the wanted terms (term, bucket)."""
        if self.words is None:
            return self.postings.join(wanted, ["bucket", "term"])
        return _counted(self.words.join(wanted.select("term"), "term"))

    def write(self, path: str) -> None:
        self.postings.repartition("bucket").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "TextIndex":
        return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(words: DataFrame) -> DataFrame:
    """Postings of tokens (key, length, term)."""
    postings = words.groupBy("key", "term").agg(F.count("*").alias("tf"), F.sum("length").alias("s"))
    # a term that occurs tf times brings the length tf times
    return postings.select("term", "key", "tf", (F.col("s") / F.col("tf")).cast("long").alias("length"), _bucket(F.col("term")).alias("bucket"))


def build(df: DataFrame, key: str, columns: Sequence[str]) -> TextIndex:
    """An index over the texts of some columns. Keys are those of single rows: rows of one key are one text."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, since a few MB of text are already much work
    dealt = df.select(col(key).alias("key"), F.concat_ws(" ", *(col(c) for c in columns)).alias("text")).repartition(parts, "key")
    rows = dealt.select("key", tokens(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    words = rows.select("key", "length", F.explode("words").alias("term"))
    totals = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    return TextIndex(_counted(words), totals, words)


def scores(index: TextIndex, queries: DataFrame, rule: Bm25 = Bm25()) -> DataFrame:
    """query, key and score for every row with a term of a query (query, text). A term counts once in a query. Terms of all
    queries meet the postings by equality. Their weights, one row for each word of the queries, are sent to where the postings lie;
    so are the queries' terms if they are few, and then the sums of a row are made there too."""
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct().withColumn("bucket", _bucket(F.col("term")))
    held = index.held(wanted)
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    rarity = frequency.crossJoin(index.totals)  # one row of totals
    idf = F.log(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = rarity.select("term", idf.alias("idf"), (F.col("tokens") / F.col("rows")).alias("mean"))
    tf, long = F.col("tf"), 1 - rule.b + rule.b * F.col("length") / F.col("mean")
    part = F.col("idf") * tf * (rule.k1 + 1) / (tf + rule.k1 * long)
    return held.join(F.broadcast(weights), "term").select("term", "key", part.alias("part")).join(asked, "term").groupBy("query", "key").agg(F.sum("part").alias("score"))


def ask(index: TextIndex, text: str, rule: Bm25 = Bm25()) -> DataFrame:
    """key and score for one query. Its terms are constants, so they and their buckets reach the scan of a written index."""
    query = index.postings.sparkSession.createDataFrame([(0, text)], "query int, text string")
    words = query.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).select("term", _bucket(F.col("term")).alias("bucket")).collect()  # of one query
    near = index.postings.where(F.col("bucket").isin([w.bucket for w in words]) & F.col("term").isin([w.term for w in words]))
    return scores(TextIndex(near, index.totals), query, rule).select("key", "score")


def best(scored: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k best rows, of each group if by is given; ties by the least key."""
    if not by:
        return scored.orderBy(F.desc("score"), "key").limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
