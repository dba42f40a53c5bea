"""Trees of any depth in parent-child tables: paths, subtrees, and changes that keep them trees.

Paths come by pointer jumping: every row holds the way up to some ancestor, and each round appends to it the way that this
ancestor holds, so the number of rounds is the logarithm of the depth. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import col, cut_lineage


def paths(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """key, path (ids from the root down to the row's own), depth (0 for a root) and cyclic. A row whose parent is null or not in the
    table is a root. Rows on a circle, or below one, have neither path nor depth and are cyclic. A key that several rows have
    counts with its least parent; rows without a key are left out."""
    rows = nodes.where(col(key).isNotNull()).groupBy(col(key).alias("id")).agg(F.min(col(parent)).alias("up"))
    known = rows.select(F.col("id").alias("known"))
    # up: the ancestor that the way ends below; null at a root
    now = rows.join(known, F.col("up") == F.col("known"), "left").select("id", F.array("id").alias("way"), F.col("known").alias("up"), F.lit(False).alias("cyclic"))
    now = cut_lineage(now)
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("id").alias("a"), F.col("way").alias("more"), F.col("up").alias("next"), F.col("cyclic").alias("bad"))
        met = now.join(above, now.up == above.a, "left")
        way = F.when(F.col("a").isNull(), F.col("way")).otherwise(F.concat("way", "more"))
        wide = met.select("id", way.alias("way"), "next", (F.col("cyclic") | F.coalesce("bad", F.lit(False))).alias("cyclic"))
        bad = F.col("cyclic") | (F.size(F.array_distinct("way")) < F.size("way"))
        now = cut_lineage(wide.select("id", F.when(bad, F.array("id")).otherwise(F.col("way")).alias("way"), F.when(~bad, F.col("next")).alias("up"), bad.alias("cyclic")))
    path = F.when(~F.col("cyclic"), F.reverse("way"))
    return now.select(F.col("id").alias(key), path.alias("path"), F.when(~F.col("cyclic"), F.size("way") - 1).alias("depth"), "cyclic")


def closure(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """ancestor, key and distance for every row and each of its ancestors, itself (0) among them."""
    found = paths(nodes, key, parent).where("not cyclic")
    return found.select(col(key), "depth", F.posexplode("path").alias("at", "ancestor")).select("ancestor", col(key), (F.col("depth") - F.col("at")).alias("distance"))


def subtree(nodes: DataFrame, key: str, parent: str, root: object) -> DataFrame:
    """The rows of root and all below it."""
    return nodes.join(paths(nodes, key, parent).where(F.array_contains("path", F.lit(root))).select(col(key)), key, "left_semi")


def subtree_sizes(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """key and nodes: how many rows stand at and below each. Counts are pre-aggregated by task, so a root costs a row from each."""
    return closure(nodes, key, parent).groupBy(F.col("ancestor").alias(key)).agg(F.count("*").alias("nodes"))


def move(nodes: DataFrame, key: str, parent: str, node: object, to: object) -> DataFrame:
    """A new version in which node stands below to (None: as a root). Raises for a node or place that isn't there, and for a place
    at or below the node itself, which would close a circle."""
    if nodes.where(col(key) == F.lit(node)).isEmpty():
        raise ValueError(f"there is no {node!r}")
    if to is not None:
        place = paths(nodes, key, parent).where(col(key) == F.lit(to)).first()
        if place is None or place.cyclic:
            raise ValueError(f"{to!r} is no place in the tree")
        if node in place.path:
            raise ValueError(f"{to!r} is at or below {node!r}")
    return nodes.withColumn(parent, F.when(col(key) == F.lit(node), F.lit(to)).otherwise(col(parent)))


def create(nodes: DataFrame, key: str, parent: str, rows: DataFrame) -> DataFrame:
    """A new version with rows added. Raises if a key is there already, or twice among the rows, or a parent is nowhere."""
    if not rows.join(nodes.select(col(key)), key, "left_semi").isEmpty() or not rows.groupBy(col(key)).count().where("count > 1").isEmpty():
        raise ValueError("a key is there already")
    every = nodes.unionByName(rows)
    known = every.select(col(key).alias("__known"))
    if not rows.where(col(parent).isNotNull()).join(known, col(parent) == F.col("__known"), "left_anti").isEmpty():
        raise ValueError("a parent is nowhere")
    return every


def update(nodes: DataFrame, key: str, changes: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """A new version in which the non-null cells of changes replace those of the rows of their keys; columns in fixed stay, and so do
    rows that changes does not name. Of several changes of a cell the least counts."""
    fields = [c for c in changes.columns if c in nodes.columns and c not in (key, *fixed)]
    new = changes.groupBy(col(key).alias("__key")).agg(*(F.min(col(c)).alias(f"__{c}") for c in fields))
    met = nodes.join(new, col(key) == F.col("__key"), "left")
    return met.select(*(F.coalesce(F.col(f"`__{c}`"), col(c)).alias(c) if c in fields else col(c) for c in nodes.columns))
