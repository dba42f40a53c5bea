"""Changes of tables as transactions: checked in the pass that writes them, taken back if they are not sound, tried again if they fail.

A table is written once, as a version in a folder of its own, and its row count, its blank keys and an order-free digest of its keys
are observed in that same pass. Equal counts and digests say that no row and no key was lost; only if they differ are the keys
of the two versions compared, so a count that a recomputed stage has raised costs a join and never a wrong verdict.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import col, is_blank, ws_trim


@dataclass(frozen=True)
class Version:
    """A written table. digest: the number of keys, the sum of their hashes and the exclusive or of other hashes of them."""

    table: DataFrame
    path: str
    key: str | None
    rows: int
    blanks: int
    digest: tuple[int, int, int]


def dropped(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _keys(df: DataFrame, key: str):
    return ws_trim(col(key).cast("string"))


def write(df: DataFrame, folder: str, key: str | None = None) -> Version:
    """df as a new version below a folder that all executors reach, in one pass. What fails while it is written is raised, and
    leaves nothing."""
    path, seen = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}", Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    if key is not None:
        k = _keys(df, key)
        low = F.xxhash64(k).bitwiseAND(F.lit((1 << 40) - 1))  # so that a sum of 2**23 rows' and more stays in a decimal
        metrics += [F.count_if(is_blank(k)).alias("blanks"), F.count(k).alias("keys"), F.sum(low.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(k, F.lit(1))).alias("mixed")]
    try:
        df.observe(seen, *metrics).write.parquet(path)
    except Exception:
        dropped(df.sparkSession, path)
        raise
    m = seen.get
    digest = (m.get("keys") or 0, int(m.get("total") or 0), m.get("mixed") or 0)
    return Version(df.sparkSession.read.schema(df.schema).parquet(path), path, key, m["rows"], m.get("blanks") or 0, digest)


def lost_keys(before: Version, after: Version) -> int:
    """How many distinct keys of the version before the other lacks."""
    if before.rows == after.rows and before.digest == after.digest:
        return 0
    old, new = (_keys(v.table, before.key).alias("k") for v in (before, after))
    return before.table.select(old).where("k is not null").distinct().join(after.table.select(new), "k", "left_anti").count()


def sound(before: Version, after: Version) -> bool:
    """Equal numbers of rows, no lost column, no lost key."""
    if set(before.table.columns) - set(after.table.columns):
        return False
    rows = (before.rows, after.rows)
    if rows[0] != rows[1]:  # counted again, since a stage that ran twice is observed twice
        rows = tuple(v.table.count() for v in (before, after))
    return rows[0] == rows[1] and (before.key is None or lost_keys(before, after) == 0)


@dataclass(frozen=True)
class Outcome:
    version: Version
    committed: bool
    errors: tuple[str, ...] = ()


def transact(before: Version, changes: Sequence[Callable[[DataFrame], DataFrame]], folder: str, attempts: int = 2) -> Outcome:
    """The first of the changes, each a way to do the same, that can be written and is sound; else the version before, untouched. The
    last change is tried as often as attempts are left, so one that an executor failed is run again."""
    errors: list[str] = []
    for attempt in range(max(attempts, len(changes))):
        change = changes[min(attempt, len(changes) - 1)]
        try:
            after = write(change(before.table), folder, before.key)
        except Exception as e:
            errors.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300])
            continue
        if sound(before, after):
            return Outcome(after, True, tuple(errors))
        errors.append("rows, columns or keys were lost")
        dropped(before.table.sparkSession, after.path)
    return Outcome(before, False, tuple(errors))


def report(before: Version, after: Version) -> DataFrame:
    """One row: rows_before, rows_after, lost_ids, lost_columns and valid, from what was observed."""
    lost = lost_keys(before, after) if before.key in after.table.columns else before.digest[0]
    gone = len(set(before.table.columns) - set(after.table.columns))
    row = (before.rows, after.rows, lost, gone, before.rows == after.rows and not lost and not gone)
    return before.table.sparkSession.createDataFrame([row], "rows_before long, rows_after long, lost_ids long, lost_columns long, valid boolean")
