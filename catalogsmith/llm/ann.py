"""Approximate nearest neighbours: a forest of random-projection trees, searched through one queue of priorities per query.

Each inner node of a tree splits by a random projection (the difference of two groups' means around random sample vectors) at
the sample's median. The forest is fitted on at most ``Forest.sample`` vectors, chosen by a hash; every vector is then routed to
its leaf in every tree. A query's search keeps the branches of all trees in one queue, ordered by the least margin by which
they were passed over, and takes leaves in that order until these hold a share of all vectors. That share is the least that
reaches ``recall`` on the sample, measured there against brute force, so it follows the data: vectors with structure need few
leaves, vectors close to random in many dimensions need many. Leaf and queries meet in one task, which ranks the leaf for
each in double precision on the original vectors, so that near-equal vectors are told apart, and names its best, as many as
asked for and one (the query itself); ties go to smaller ids. The visits of a query are written as one row; a count of them by
leaf then says into how many lots the queries of a leaf are dealt, so that no task meets more than about ``part`` vectors and
``lot`` queries of a leaf, however many visit it.

Equal vectors are indexed once, with their least ids, as many as a result can show; equal queries are searched once. So any
number of copies costs nothing, and ties go to smaller ids. A leaf that holds more than ``part`` vectors is dealt to several
tasks, and each lot of its queries to all of them. Vectors that are null, zero, of another length than most, or with null or non-finite
components take no part. Fewer candidates than asked for: all of them. An empty table: no rows. Repeated rows are one vector. An
id with several vectors is each of them: as a query it gets one ranking of its nearest over all of them (another id counts once, with its best
cosine), and it is never its own neighbour.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .sparkio import mapped, quoted, written


@dataclass(frozen=True)
class Forest:
    trees: int = 2
    leaf: int = 1024
    sample: int = 40_000
    #: What the search is to reach on the sample, and the sample's queries that this is measured on.
    recall: float = 0.97
    probes: int = 150
    part: int = 8192
    lot: int = 8192
    #: Visits of queries that a task holds before it passes them on.
    held: int = 100_000
    #: Candidates of a query whose copies are looked up and ranked, as a multiple of the number asked for.
    rerank: int = 4


@dataclass
class Tree:
    normals: np.ndarray  # per inner node
    offsets: np.ndarray
    children: np.ndarray  # two per inner node; a leaf is -1 - its number
    leaves: int


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Splits down to depth, or until a node has fewer than four sample vectors."""
    normals, offsets, children, leaves = [], [], [], 0

    def node(rows: np.ndarray, level: int) -> int:
        nonlocal leaves
        if level == depth or len(rows) < 4:
            leaves += 1
            return -leaves
        few = sample[rng.choice(rows, min(len(rows), 256), replace=False)]
        a, b = few[rng.choice(len(few), 2, replace=False)]
        for _ in range(2):
            near = few @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = few[near].mean(0), few[~near].mean(0)
        normal = a - b
        if not (norm := np.linalg.norm(normal)) > 1e-9:
            normal, norm = rng.normal(size=sample.shape[1]), np.sqrt(sample.shape[1])
        normal = (normal / norm).astype(np.float32)
        along = sample[rows] @ normal
        cut = float(np.median(along))
        right = along > cut
        if right.all() or not right.any():
            leaves += 1
            return -leaves
        i = len(normals)
        normals.append(normal)
        offsets.append(cut)
        children.append([0, 0])
        children[i] = [node(rows[~right], level + 1), node(rows[right], level + 1)]
        return i

    root = node(np.arange(len(sample)), 0)
    d = sample.shape[1]
    assert root <= 0
    return Tree(np.array(normals, np.float32).reshape(-1, d), np.array(offsets, np.float32), np.array(children, np.int64).reshape(-1, 2), leaves)


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64) if len(tree.normals) else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        k = at[inner]
        side = np.einsum("ij,ij->i", x[inner], tree.normals[k]) > tree.offsets[k]
        at[inner] = tree.children[k, side.astype(np.int64)]
    return -1 - at


def search(trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray, want: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs to visit, by one queue for all trees, until their leaves hold want vectors."""
    queue = [(0.0, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(trees)]
    found, held = [], 0
    margins = [tree.normals @ query - tree.offsets for tree in trees]
    while queue and held < want:
        passed, t, at = heapq.heappop(queue)
        while at >= 0:
            margin = float(margins[t][at])
            near, far = trees[t].children[at, int(margin > 0)], trees[t].children[at, int(margin <= 0)]
            heapq.heappush(queue, (max(passed, abs(margin)), t, int(far)))
            at = int(near)
        found.append((t, -1 - at))
        held += int(sizes[t][-1 - at])
    return found


def share_to_visit(trees: list[Tree], sample: np.ndarray, k: int, forest: Forest, rng: np.random.Generator) -> float:
    """The share of vectors (each tree's counted) to visit for the recall asked for."""
    n = len(sample)
    if n <= 2 * k:
        return float(len(trees))
    leaf = [route(tree, sample) for tree in trees]
    sizes = [np.bincount(at, minlength=tree.leaves) for at, tree in zip(leaf, trees)]
    asked = rng.choice(n, min(n, forest.probes), replace=False)
    close = sample[asked] @ sample.T
    close[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-close, k, axis=1)[:, :k]
    order = [{visit: i for i, visit in enumerate(search(trees, sizes, sample[q], n * len(trees)))} for q in asked]
    held = [np.cumsum([sizes[t][at] for t, at in visits]) for visits in order]
    # when each true neighbour is first met, as a share
    met = np.array([min(held[i][order[i][t, int(leaf[t][j])]] for t in range(len(trees))) / n for i in range(len(asked)) for j in true[i]])
    return float(min(np.quantile(met, forest.recall) * 1.05 + forest.leaf / n, len(trees)))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, initial=0, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _numbers(raw: bytes) -> np.ndarray:
    """A vector from its bytes: one that tells the type (4: float32, 8: float64, as in the table), then the numbers."""
    return np.frombuffer(raw, f"<f{raw[0]}", offset=1)


def _matrix(rows: pa.Array | list[bytes]) -> np.ndarray:
    """Rows of a fixed length from vectors' bytes."""
    rows = rows if isinstance(rows, list) else rows.to_pylist()
    return np.stack([_numbers(b) for b in rows]) if rows else np.zeros((0, 1), np.float32)


def sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and raw (see _numbers) of the vectors that take part: as float32 if the table has floats, else as float64."""
    v = F.col("v")
    size = 4 if df.schema[vector_col].dataType == ArrayType(FloatType(), df.schema[vector_col].dataType.containsNull) else 8
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<float>" if size == 4 else "array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(good)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype(f"<f{size}"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            raw = [bytes([size]) + flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    found = mapped(rows, step, "vec_id long, raw binary")
    most = found.groupBy(F.length("raw").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.length("raw") == (most.n if most else 0))


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", forest: Forest = Forest(), seed: int = 5) -> DataFrame:
    """For each vector whose id is divisible by every: query_id, rank (from 1), vec_id and score (cosine) of its k nearest others."""
    spark = df.sparkSession
    vectors = sound(df, id_col, vector_col).withColumn("key", F.sha2("raw", 256).substr(1, 32))
    copies = Window.partitionBy("key").orderBy("vec_id")
    # One more than asked for: a query may be among them. The limit on row_number applies before the shuffle, too, and repeated
    # rows are one before it (raw is a function of key).
    members = written(vectors.groupBy("key", "vec_id").agg(F.first("raw").alias("raw")).withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1), "ann-members")
    queries = written(vectors.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id")).distinct(), "ann-queries")
    texts = members.where("place = 1").select("key", "vec_id", "raw")
    count = texts.count()
    bound = F.lit(int((min(1.0, 1.1 * forest.sample / max(count, 1)) - 0.5) * 1.9999 * 2**63))
    rows = sorted((r.h, bytes(r.raw)) for r in texts.select("raw", F.xxhash64("key").alias("h")).where(F.col("h") <= bound).limit(2 * forest.sample).collect())
    sample = _matrix([r[1] for r in rows])
    sample = _unit(sample).astype(np.float32) if len(rows) else sample
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / forest.leaf))))
    trees = [grow(sample, depth, np.random.default_rng(seed + t)) for t in range(forest.trees)]
    share = share_to_visit(trees, sample, k, forest, np.random.default_rng(seed)) if len(sample) else 1.0
    want = int(np.ceil(share * count))
    shared = spark.sparkContext.broadcast(trees)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1))).astype(np.float32)
            for t, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(route(tree, x), pa.int32()), batch.column(0), batch.column(1)], names=["tree", "leaf", "vec_id", "raw"])

    placed = mapped(texts.select("vec_id", "raw"), leaves, "tree int, leaf int, vec_id long, raw binary")
    sizes = [np.zeros(tree.leaves, np.int64) for tree in trees]
    for r in placed.groupBy("tree", "leaf").count().collect():  # a row per leaf: bounded by the sample
        sizes[r.tree][r.leaf] = r["count"]
    known = spark.sparkContext.broadcast(sizes)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1))).astype(np.float32)
            begin, found, held = 0, [], 0
            for i, query in enumerate(x, 1):
                found.append([{"tree": t, "leaf": leaf} for t, leaf in search(shared.value, known.value, query, want)])
                held += len(found[-1])
                if held >= forest.held or i == len(x):
                    at = pa.array(found, pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, i - begin) for c in batch.columns), at], names=["asked", "raw", "visits"])
                    begin, found, held = i, [], 0

    asked = texts.join(queries.select("key").distinct(), "key", "left_semi").select("vec_id", "raw")
    searched = written(mapped(asked.repartition("vec_id"), visits, "asked long, raw binary, visits array<struct<tree: int, leaf: int>>"), "ann-visits")
    visited = searched.select("asked", "raw", F.explode("visits").alias("at")).select("asked", "raw", "at.tree", "at.leaf")
    # A row per visited leaf, so bounded by the sample as well.
    dealt = [(r.tree, r.leaf, -(-int(sizes[r.tree][r.leaf]) // forest.part), -(-r["count"] // forest.lot)) for r in visited.groupBy("tree", "leaf").count().collect()]
    leaf_parts = F.broadcast(spark.createDataFrame(dealt, "tree int, leaf int, parts int, lots int"))
    placed = placed.join(leaf_parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    wanted = visited.join(leaf_parts, ["tree", "leaf"]).withColumn("lot", F.pmod(F.xxhash64("asked"), "lots").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["tree", "leaf", "part", "lot"]
    placed, wanted = placed.select(*by, "vec_id", "raw"), wanted.select(*by, "asked", "raw")
    take, each = (k + 1) * forest.rerank, k + 1

    def rank(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asking):
            return pd.DataFrame({"asked": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "near": np.zeros(0)})
        x = _unit(_matrix(list(held["raw"])))
        order = np.argsort(held["vec_id"].to_numpy())
        x, ids, asked_ids, out_ids, nears = x[order], held["vec_id"].to_numpy()[order], [], [], []
        most = min(each, len(ids))
        for begin in range(0, len(asking), 512):
            some = asking.iloc[begin : begin + 512]
            close = _unit(_matrix(list(some["raw"]))) @ x.T
            best = np.argpartition(-close, most - 1, axis=1)[:, :most]
            least = np.take_along_axis(close, best, 1).min(1)
            for i in np.flatnonzero((close >= least[:, None]).sum(1) > most):  # a tie at the last place
                level = np.flatnonzero(close[i] == least[i])
                above = np.flatnonzero(close[i] > least[i])
                best[i] = np.concatenate([above, level[: most - len(above)]])
            asked_ids.append(np.repeat(some["asked"].to_numpy(), most))
            out_ids.append(ids[best].ravel())
            nears.append(np.take_along_axis(close, best, 1).ravel())
        return pd.DataFrame({"asked": np.concatenate(asked_ids), "vec_id": np.concatenate(out_ids), "near": np.concatenate(nears)})

    close = placed.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(rank, "asked long, vec_id long, near double")
    # A vector may be named once by each tree; the limit on row_number applies within tasks before the shuffle.
    top = Window.partitionBy("asked").orderBy(F.desc("near"), "vec_id")
    best = close.withColumn("r", F.row_number().over(top)).where(F.col("r") <= take * forest.trees).select("asked", "vec_id").distinct()
    return _exact(written(best, "ann-best"), members, queries, texts, k)


def _exact(best: DataFrame, members: DataFrame, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Ranks each query's candidates, with the copies of each, by the cosine of the original vectors."""
    found = best.join(texts.select("vec_id", F.col("key").alias("c_key"), F.col("raw").alias("c_raw")), "vec_id").drop("vec_id")
    pairs = found.join(texts.select(F.col("vec_id").alias("asked"), F.col("key").alias("q_key"), F.col("raw").alias("q_raw")), "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_matrix(batch.column(i)).astype(np.float64) for i in (2, 3))
            if max(np.abs(a).max(), np.abs(b).max()) > 1e100 or min(np.abs(a).max(1).min(), np.abs(b).max(1).min()) < 1e-100:
                a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))  # their squares are beyond a double
            cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["q_key", "c_key", "score"])

    scored = mapped(pairs.select("q_key", "c_key", "q_raw", "c_raw"), score, "q_key string, c_key string, score double")
    full = scored.join(members.select(F.col("key").alias("c_key"), "vec_id"), "c_key").join(queries.withColumnRenamed("key", "q_key"), "q_key").where("vec_id != query_id")
    full = full.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
