"""Making a crosswalk for a new source: a stored one if it still fits, else exact names, then proposals behind a guard."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.text import SEPARATORS, valid_separators
from ..operators import crosswalk
from ..operators.crosswalk import Crosswalk, Mapping, Settings
from ..schema import GENERIC_FIELDS, col, is_blank

#: Proposals for the columns that are left: (columns, what failed before or None) to mappings.
Proposer = Callable[[Sequence[str], dict | None], Sequence[Mapping]]


def stored(path: str, df: DataFrame) -> Crosswalk | None:
    """A stored crosswalk, if there is one, no column that it names is gone, and it passes the test on a few rows."""
    if not os.path.exists(path):
        return None
    plan = Crosswalk.load(path)
    return plan if not plan.missing_columns(df.columns) and crosswalk.sound(crosswalk.smoke_test(df, plan)) else None


def guarded(proposed: Sequence[Mapping], columns: Sequence[str]) -> tuple[Mapping, ...]:
    """Proposals whose plain parts all exist and whose target is a generic field, in lower case."""
    known = [m for m in proposed if m.left.strip() and all("*" in p or p in columns for p in m.parts)]
    return tuple(Mapping(m.left, m.replace.strip().lower(), m.default, m.required, m.filter) for m in known if m.replace.strip().lower() in GENERIC_FIELDS)


def joined(*lists: Sequence[Mapping]) -> tuple[Mapping, ...]:
    """The first mapping of each left side; earlier lists come first."""
    return tuple({m.left: m for ms in reversed(lists) for m in reversed(ms)}[k] for k in dict.fromkeys(m.left for ms in lists for m in ms))


def separators(df: DataFrame, mappings: Sequence[Mapping]) -> Settings:
    """The separator of the first non-blank author value; none found: the usual one."""
    for m in mappings:
        for name in m.parts:
            if m.replace == "author" and name in df.columns:
                first = df.where(~is_blank(col(name))).select(valid_separators(col(name), SEPARATORS).alias("s")).first()
                if first and first.s:
                    return Settings(original_separator=first.s[0])
    return Settings()


def generate(df: DataFrame, path: str, propose: Proposer | None = None) -> tuple[Crosswalk, dict[str, list[str]]]:
    """The crosswalk for a source, stored at path (on the driver), and what its test on a few rows found. Proposals are asked for
    once more, with what failed, if the test fails."""
    if plan := stored(path, df):
        return plan, crosswalk.smoke_test(df, plan)
    exact = crosswalk.fallback_mappings(df.columns)
    left = crosswalk.remnants(df.columns, exact)
    plan, check, failed = exact, {}, None
    for _ in range(2):
        offered = guarded(propose(left, failed), df.columns) if propose and left else ()
        mappings = joined(exact.mappings, offered)
        plan = Crosswalk(mappings, separators(df, mappings))
        with open(path, "w", encoding="utf-8") as out:
            out.write(plan.dump())
        check = failed = crosswalk.smoke_test(df, plan)
        if crosswalk.sound(check) or not (propose and left):
            break
    return plan, check


def run_folder(parent: str, source: str, day: str) -> str:
    """The folder of a new run: source, day, and one more than the runs of that day that are there."""
    held = os.listdir(parent) if os.path.isdir(parent) else []
    return os.path.join(parent, f"{source}_{day}_{1 + sum(name.startswith(f'{source}_{day}_') for name in held)}")
