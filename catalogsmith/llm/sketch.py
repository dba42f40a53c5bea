"""Count-min sketches of document frequencies, filled in one pass over a corpus and summed in blocks.

A sketch has DEPTH rows of 2**BITS counters, whatever the corpus: 8 MB, a proven bound for what is collected and broadcast.
A frequency is overstated by at most e / 2**BITS times the mean number of distinct items per document (as a share of all
documents) but for a chance of e**-DEPTH, at every size of the corpus alike; it is never understated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .sparkio import mapped

BITS, DEPTH = 20, 2
_BLOCK = 1 << 15
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def cells(hashes: np.ndarray, row: int) -> np.ndarray:
    return (hashes * np.uint64(_FACTORS[row]) >> np.uint64(64 - BITS)).astype(np.int64)


class Counts:
    """The sketch of one task."""

    def __init__(self) -> None:
        self.rows = np.zeros((DEPTH, 1 << BITS), np.int64)
        self.documents = 0

    def add(self, hashes: np.ndarray, documents: int) -> None:
        for k in range(DEPTH):
            self.rows[k] += np.bincount(cells(hashes, k), minlength=1 << BITS)
        self.documents += documents

    def blocks(self) -> Iterator[dict]:
        """Rows of block, part (of 16 tasks) and counts (int64, little-endian); block -1 has the number of documents."""
        part = TaskContext.get().partitionId() // 16
        flat = self.rows.ravel()
        if self.documents:
            yield {"block": -1, "part": part, "counts": np.array([self.documents], "<i8").tobytes()}
            for k in range(0, len(flat), _BLOCK):
                if flat[k : k + _BLOCK].any():
                    yield {"block": k // _BLOCK, "part": part, "counts": flat[k : k + _BLOCK].astype("<i8").tobytes()}


def _added(parts: DataFrame) -> DataFrame:
    """One row for each block and part, added up as rows stream in: a task holds its blocks' sums, not their rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                more = np.frombuffer(counts, "<i8")
                sums[block, part] = sums[block, part] + more if (block, part) in sums else more
        for (block, part), total in sums.items():
            yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "counts": total.tobytes()}], schema=BLOCKS)

    return mapped(parts.repartition("block", "part"), add, BLOCK_SCHEMA)


def summed(parts: DataFrame) -> tuple[np.ndarray, int]:
    """The whole sketch and the number of documents, from the blocks of all tasks: first of 16 tasks, then of 64 of these parts,
    then of all, so that no task gathers a block from many tasks at once."""
    some = _added(_added(parts).selectExpr("block", "part div 64 as part", "counts").selectExpr("block", "cast(part as int) as part", "counts"))
    rows = _added(some.selectExpr("block", "0 as part", "counts")).collect()
    flat, documents = np.zeros(DEPTH << BITS, np.int64), 0
    for row in rows:
        counts = np.frombuffer(row.counts, "<i8")
        if row.block < 0:
            documents = int(counts[0])
        else:
            flat[row.block * _BLOCK : (row.block + 1) * _BLOCK] = counts
    return flat.reshape(DEPTH, -1).clip(max=2**31 - 1).astype(np.int32), documents


def frequency(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """At least the number of documents with each item."""
    out = sketch[0][cells(hashes, 0)]
    for k in range(1, DEPTH):
        out = np.minimum(out, sketch[k][cells(hashes, k)])
    return out


BLOCKS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def block_batches(counts: Counts) -> Iterable[pa.RecordBatch]:
    for row in counts.blocks():
        yield pa.RecordBatch.from_pylist([row], schema=BLOCKS)


BLOCK_SCHEMA = "block int, part int, counts binary"
__all__ = ["BITS", "BLOCK_SCHEMA", "Counts", "block_batches", "frequency", "summed"]
