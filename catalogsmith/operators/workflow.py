"""The life of a submission as versions of a table: workspace, pool of tasks, claimed tasks, archive."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import col

#: What an action makes of a state. Any other pair is refused. Submitting to a collection without reviewers archives at once.
TRANSITIONS: Mapping[tuple[str, str], str] = {
    ("workspace", "submit"): "pool",
    ("workspace", "delete"): "deleted",
    ("pool", "claim"): "claimed",
    ("pool", "return"): "workspace",
    ("pool", "expunge"): "deleted",
    ("claimed", "approve"): "archived",
    ("claimed", "reject"): "workspace",
    ("claimed", "unclaim"): "pool",
    ("claimed", "return"): "workspace",
    ("claimed", "expunge"): "deleted",
}


def next_state(state: Column, action: Column, reviewed: Column | None = None) -> Column:
    """The state after an action; null if the state does not allow it. Without reviewers (reviewed is false) submit archives."""
    known = reduce(lambda so_far, item: so_far.when((state == item[0][0]) & (action == item[0][1]), item[1]), TRANSITIONS.items(), F.when(F.lit(False), ""))
    if reviewed is None:
        return known
    return F.when((state == "workspace") & (action == "submit") & ~F.coalesce(reviewed, F.lit(True)), "archived").otherwise(known)


def apply_actions(items: DataFrame, actions: DataFrame, key: str = "id", state: str = "state", reviewed: str | None = None) -> DataFrame:
    """items with the new state, and outcome: null without an action, else done or refused.

    actions has key, pos and action. A version takes one action an item, that of least pos (ties: the lesser action); later ones
    wait for the next version. Actions on unknown or null keys, null actions and null positions change nothing. A deleted item
    stays as a row, so that an action repeated after a failure is refused and not taken for one on an unknown item.
    """
    first = actions.where(F.col("action").isNotNull() & F.col("pos").isNotNull()).groupBy(col(key).alias("__key")).agg(F.min(F.struct("pos", "action")).alias("__first"))
    joined = items.join(first, col(key) == F.col("__key"), "left")
    after = next_state(col(state), F.col("__first.action"), col(reviewed) if reviewed else None)
    outcome = F.when(F.col("__first").isNotNull(), F.when(after.isNotNull(), "done").otherwise("refused"))
    kept = [F.coalesce(after, col(state)).alias(state) if c == state else col(c) for c in items.columns]
    return joined.select(*kept, outcome.alias("outcome"))
