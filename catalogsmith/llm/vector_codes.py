"""Vector compression by integer product quantisation.

Components become integers, floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a
codebook of integer entries that starts as that part of the vectors of least id. Each round broadcasts the codebooks (entries x
width numbers, a fixed size), assigns every part to its nearest entry, and sums the parts of each entry: Arrow batches compute
all distances through the expansion |e|**2 - 2 x.e with exact int64 matrix products, the first least one wins, each task sends
its sums for each entry once, and a grouped shuffle merges them. Entries move to the floor of their mean; unused ones stay. The
source is read once a round; nothing of the size of the table is kept.

Vectors that are null, or hold null or non-finite components, take no part. Vectors shorter than the longest, or not a multiple
of the number of parts, are filled up with zeros; an empty vector is all zeros. Integers are held within 2**27 in size, so that
no product leaves 64 bits. Rows with a null id come after all others in the order of ids; of rows with one id the lesser vector
is first. Repeated rows are coded each. With fewer vectors than entries there are as many entries as vectors. A sum of errors
beyond a long is null. An empty table has no codebooks and gives no rows. Only the named columns are read, so names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from .sparkio import mapped, quoted

MOST = 1 << 27


@dataclass(frozen=True)
class Layout:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass
class Codebooks:
    entries: np.ndarray  # parts x entries x numbers, int64
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """sha256 over all numbers by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def sound(df: DataFrame, vector_col: str, **others: Column) -> DataFrame:
    """v (array of double) of the vectors that take part, and other columns under names of their own."""
    rows = df.select(*(c.alias(name) for name, c in others.items()), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~odd)


def integers(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Rows of width integers."""
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.float64)
    whole = np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64)
    sizes = np.diff(bounds)
    if (sizes == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row (the first of equals), and the sum of squared distances."""
    parts, _, each = books.shape
    codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p in range(parts):
        part = np.ascontiguousarray(x[:, p * each : (p + 1) * each])
        far = (books[p] * books[p]).sum(1) - 2 * (part @ books[p].T)
        codes[:, p] = far.argmin(1)
        error += far[np.arange(len(x)), codes[:, p]] + (part * part).sum(1)
    return codes, error


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, count, each = books.entries.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, number = np.zeros(books.entries.shape, np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            x = integers(batch.column(0), books.width, books.scale)
            codes, _ = assign(x, books.entries)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p * each : (p + 1) * each])
                number[p] += np.bincount(codes[:, p], minlength=count)
        part, entry = np.nonzero(number)
        where = [np.repeat(k, each) for k in (part, entry)]
        columns = [*where, np.tile(np.arange(each), len(part)), np.repeat(number[part, entry], each), total[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "position", "n", "s"])

    sums = mapped(rows.select("v"), step, "part long, entry long, position long, n long, s long")
    out = books.entries.copy()
    for r in sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # the size of the codebooks
        out[r.part, r.entry, r.position] = r.s // r.n
    shared.unpersist()
    return Codebooks(out, books.scale)


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", layout: Layout = Layout()) -> Codebooks | None:
    """Codebooks after all rounds; None without a vector."""
    rows = sound(df, vector_col, id=F.col(quoted(id_col)))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return None
    each = max(1, -(-longest // layout.parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(layout.entries).select("v").collect()
    flat = pa.array([r.v for r in first], pa.list_(pa.float64()))
    seeds = integers(flat, layout.parts * each, layout.scale).reshape(len(first), layout.parts, each)
    books = Codebooks(np.ascontiguousarray(seeds.transpose(1, 0, 2)), layout.scale)
    for _ in range(layout.rounds):
        books = _moved(rows, books)
    return books


def encode(df: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code (a byte for each part) and error (long: the sum of squared distances of the integers)."""
    rows = sound(df, vector_col, id=F.col(quoted(id_col)), label=F.col(quoted(label_col)))
    schema = StructType([*rows.schema.fields[:2], StructField("code", BinaryType()), StructField("error", LongType())])
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            codes, error = assign(integers(batch.column(2), books.width, books.scale), books.entries)
            raw = codes.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(error)], names=["id", "label", "code", "error"])

    return mapped(rows, step, schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """id and vector (array of double): what the codes stand for, with the zeros that filled it up."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts = np.arange(books.entries.shape[0])
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(parts))
            vectors = (books.entries[parts, codes] / books.scale).reshape(len(codes), books.width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=["id", "vector"])

    schema = StructType([coded.schema["id"]]).add("vector", ArrayType(DoubleType()))
    return mapped(coded.select("id", "code"), step, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """With label_error: the sum of errors over equal labels (nulls are one). The sums are a row for each task and label before
    they meet, and the table of them is joined by size."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def _round_sql(k: int) -> str:
    return f"""
far{k} AS (SELECT x.rid, x.p, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM numbers x JOIN books{k} b ON x.p = b.p AND x.i = b.i GROUP BY ALL),
near{k} AS (SELECT rid, p, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM far{k} GROUP BY rid, p),"""


def _moved_sql(k: int) -> str:
    return f"""
means{k} AS (SELECT n.p, n.entry, x.i, sum(x.v) AS s, count(*) AS c FROM near{k} n JOIN numbers x ON n.rid = x.rid AND n.p = x.p GROUP BY ALL),
books{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, b.i, coalesce((m.s - ((m.s % m.c) + m.c) % m.c) // m.c, b.v)::BIGINT AS v FROM books{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.entry = m.entry AND b.i = m.i),"""


#: The same in SQL, for vectors of one length that is a multiple of 16.
ORACLE = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT rid, unnest(embedding) AS x, unnest(range(len(embedding))) AS place, len(embedding) // 16 AS w FROM kept),
numbers AS MATERIALIZED (SELECT rid, place // w AS p, place % w AS i, floor(256 * x::DOUBLE)::BIGINT AS v FROM flat),
books0 AS MATERIALIZED (SELECT p, rid - 1 AS entry, i, v FROM numbers WHERE rid <= 64),
{_round_sql(0)}{_moved_sql(0)}{_round_sql(1)}{_moved_sql(1)}{_round_sql(2)}
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM books2),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY rid),
found AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k JOIN coded c ON k.rid = c.rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM found, digest
"""
