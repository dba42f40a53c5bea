"""Catalog search: filter lists, a small query language, dimensions, trees and upserts, all as predicates that push down."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import col

_FILTER = re.compile(r"^(from|until)-([\w-]+)$")


def _and(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filters(spec: str, fields: Mapping[str, str]) -> Column:
    """``from-x:v``, ``until-x:v``, ``has-x:true`` and ``x:v``, apart by commas and all required. Names are looked up in fields;
    an unknown one is an error."""
    out = []
    for item in filter(None, (s.strip() for s in (spec or "").split(","))):
        name, _, value = item.partition(":")
        if m := _FILTER.match(name):
            c = col(fields[m[2]])
            out.append(c >= F.lit(value) if m[1] == "from" else c <= F.lit(value))
        elif name.startswith("has-"):
            there = col(fields[name[4:]]).isNotNull()
            out.append(there if value.lower() != "false" else ~there)
        else:
            out.append(col(fields[name]) == F.lit(value))
    return _and(out)


def free_text(query: str, columns: Sequence[str]) -> Column:
    """Every word of the query in one of the columns, whatever the case."""
    words = [w for w in (query or "").lower().split() if w]
    return _and([reduce(lambda a, b: a | b, (F.lower(col(c)).contains(w) for c in columns)) for w in words])


def sorted_by(df: DataFrame, spec: str | None, tie: str) -> DataFrame:
    """``field`` or ``field:desc``, and ties by the key."""
    if not spec:
        return df.orderBy(tie)
    name, _, way = spec.partition(":")
    return df.orderBy(col(name).desc() if way == "desc" else col(name).asc(), tie)


def after_cursor(spec: str | None, tie: str, cursor: tuple) -> Column:
    """Rows after the cursor, (value of the sorted field, key) of the last row of a page, in the order of sorted_by; without a
    sort (key,). Nulls come first in ascending order and last in descending order."""
    further = col(tie) > F.lit(cursor[-1])
    if not spec:
        return further
    name, _, way = spec.partition(":")
    c, value = col(name), cursor[0]
    if value is None:
        return c.isNull() & further if way == "desc" else c.isNotNull() | further
    beyond = (c < F.lit(value)) | c.isNull() if way == "desc" else c > F.lit(value)
    return beyond | ((c == F.lit(value)) & further)


def search(df: DataFrame, key: str, query: str = "", columns: Sequence[str] = (), where: str = "", fields: Mapping[str, str] | None = None, select: Sequence[str] = (), sort: str | None = None, rows: int = 20, offset: int = 0, cap: int = 1000, scoped: Mapping[str, str] | None = None, cursor: tuple | None = None) -> DataFrame:
    """A page of works: filters first (they reach the scan), then order, offset and limit. scoped holds texts for single columns
    (an author's, a title's); a cursor (see after_cursor) goes on after a page without reading past rows again in order."""
    found = df.where(filters(where, fields or {c: c for c in df.columns}) & free_text(query, columns))
    found = found.where(_and([free_text(text, [c]) for c, text in (scoped or {}).items()]))
    if cursor is not None:
        found = found.where(after_cursor(sort, key, cursor))
    page = sorted_by(found, sort, key).offset(offset).limit(min(rows, cap))
    return page.select(*select) if select else page


_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|(\w+):\[\s*(\S+)\s+TO\s+(\S+)\s*\]|(?:(\w+):)?"([^"]*)"|(?:(\w+):)?([^\s()]+))')


def parse_query(query: str, fields: Mapping[str, str], default: Sequence[str]) -> Column:
    """``field:value``, ``"a phrase"``, ``field:[a TO b]``, AND, OR, NOT and brackets; neighbours without a word between them are
    both required. AND binds closer than OR."""
    tokens, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"can't read {query[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def term(m: re.Match) -> Column:
        if m[4]:
            c, low, high = col(fields[m[4]]), m[5], m[6]
            return _and(([c >= F.lit(low)] if low != "*" else []) + ([c <= F.lit(high)] if high != "*" else []))
        name, value = (m[7], m[8]) if m[8] is not None else (m[9], m[10])
        columns = [fields[name]] if name else default
        return reduce(lambda a, b: a | b, (F.lower(col(c).cast("string")).contains(value.lower()) for c in columns))

    def unit() -> Column:
        nonlocal place
        m = tokens[place]
        place += 1
        if m[3] == "NOT":
            return ~unit()
        if m[1]:
            inner = either()
            place += 1
            return inner
        return term(m)

    def both() -> Column:
        nonlocal place
        out = unit()
        while place < len(tokens) and not tokens[place][2] and tokens[place][3] != "OR":
            if tokens[place][3] == "AND":
                place += 1
            out = out & unit()
        return out

    def either() -> Column:
        nonlocal place
        out = both()
        while place < len(tokens) and tokens[place][3] == "OR":
            place += 1
            out = out | both()
        return out

    return either() if tokens else F.lit(True)


def works_of(facts: DataFrame, dimension: DataFrame, on: str, where: Column) -> DataFrame:
    """Works of the dimension rows that a condition takes (journals, funders, members, institutions, authors)."""
    return facts.join(dimension.where(where).select(on).distinct(), on, "left_semi")


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(col(key) == F.lit(value))


def agency(works: DataFrame, doi: str, registrants: DataFrame) -> DataFrame:
    """works with agency, by the DOI's prefix (up to the first slash) in registrants (prefix, agency; the least agency of
    repeated prefixes); null for a prefix or DOI that is unknown."""
    known = registrants.groupBy(F.col("prefix").alias("__prefix")).agg(F.min("agency").alias("agency"))
    return works.join(known, F.substring_index(F.trim(col(doi)), "/", 1) == F.col("__prefix"), "left").drop("__prefix")


def licenses(works: DataFrame, column: str) -> DataFrame:
    """Each license and the number of works under it; works without one are left out."""
    return works.where(col(column).isNotNull()).groupBy(col(column).alias("license")).agg(F.count("*").alias("works"))


def prefixed(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(col(key).startswith(prefix))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def children(tree: DataFrame, parent: str, value: object) -> DataFrame:
    return tree.where(col(parent) == F.lit(value))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A new version of the table: rows replace those of their keys."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def seeded(table: DataFrame, defaults: DataFrame) -> DataFrame:
    """The table, or the default rows if it has none. One row decides, which at most one row of each task is read for."""
    none = table.select(F.lit(1).alias("__one")).limit(1).agg((F.count("*") == 0).alias("__none"))
    return table.unionByName(defaults.join(F.broadcast(none), F.col("__none")).drop("__none"))


def replace_archived(items: DataFrame, rows: DataFrame, key: str, archived: str) -> DataFrame:
    """A new version in which rows (one a key) replace archived items wholly; rows of items not archived, or unknown, have no
    effect."""
    open_to = items.where(col(archived)).select(key)
    return upsert(items, rows.join(open_to, key, "left_semi"), key)


def bundles(items: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The files of items, grouped by bundle."""
    return items.select(key).distinct().join(files, key)
