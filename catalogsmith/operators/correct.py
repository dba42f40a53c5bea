"""Corrections before export, repair strategies, and the registries of both."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import CURATION_FIELDS, col, find_by_pattern, is_blank
from .validate import commit_or_rollback

Corrector = Callable[[DataFrame], DataFrame]
AUTHOR_CAP = 30
_correctors: dict[str, Corrector] = {}
_strategies: dict[str, Callable[..., Column]] = {}


def register_corrector(source: str, corrector: Corrector) -> None:
    _correctors[source.strip().lower()] = corrector


def get_corrector(source: str) -> Corrector:
    """The corrector of a source, whatever the case of its name, or the generic one."""
    return _correctors.get((source or "").strip().lower(), generic_corrections)


def generic_corrections(df: DataFrame) -> DataFrame:
    """Canonical separators in all text columns, then language codes in language columns."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            c = t.canonical_separators(col(f.name))
            out[f.name] = t.language_code(c) if re.match(r"(?i)^dc\.language", f.name) else c
    return df.select(*(out[c].alias(c) if c in out else col(c) for c in df.columns))


def fill_place(df: DataFrame, place: str, affiliation: str) -> DataFrame:
    return df.withColumn(place, F.when(is_blank(col(place)) & ~is_blank(col(affiliation)), col(affiliation)).otherwise(col(place)))


def cap_authors(authors: Column, institutional: Column, cap: int = AUTHOR_CAP, separator: str = "||") -> Column:
    """Of more authors than the cap, only those of the institution, if there are any; else all."""
    own = t.split_values(institutional, separator)
    return F.when((F.size(t.split_values(authors, separator)) > cap) & (F.size(own) > 0), F.array_join(own, separator)).otherwise(authors)


def capped_list(c: Column, n: int, separator: str = "|") -> Column:
    return F.array_join(F.slice(t.split_values(c, separator), 1, n), separator)


def map_values(c: Column, values: Mapping[str, str]) -> Column:
    """An exact match takes its value; else each key in turn is replaced inside the text, whatever the case."""
    exact = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]
    inside = c
    for k, v in values.items():
        inside = F.regexp_replace(inside, "(?iu)" + re.escape(k).replace("\\ ", " "), v.replace("\\", "\\\\").replace("$", "\\$"))
    return F.coalesce(exact, inside)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, where there is one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)).otherwise(c)


def register_strategy(name: str, rule: Callable[..., Column]) -> None:
    _strategies[name] = rule


def strategy(name: str) -> Callable[..., Column]:
    """The repair by name; an unknown one changes nothing."""
    return _strategies.get(name, lambda c, **_: c)


register_strategy("value_mapping", lambda c, values: map_values(c, values))
register_strategy("regex_extraction", lambda c, pattern, group=1: extract(c, pattern, group))
register_strategy("date_normalization", lambda c: t.clean_date(c))


def auto_repairable(confidence: Column, ambiguous: Column, applicable: Column) -> Column:
    return (F.lower(confidence) == "high") & ~ambiguous & applicable


def repair(df: DataFrame, key: str, column: str, name: str, **parameters: object) -> DataFrame:
    """A repair as a transaction: kept only if rows, columns and ids are whole."""
    return commit_or_rollback(df, df.withColumn(column, strategy(name)(col(column), **parameters)), key)


HUMAN_ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "accept": commit_or_rollback,
    "provide": lambda before, proposal, key: proposal,
    "abort": lambda before, proposal, key: before,
}


def canonical_columns(df: DataFrame) -> DataFrame:
    """The curation fields in their order, then others as they came; internal ones (from an underscore) go."""
    first = [col(f).cast("string").alias(f) if f in df.columns else F.lit("").alias(f) for f in CURATION_FIELDS]
    return df.select(*first, *(col(c) for c in df.columns if c not in CURATION_FIELDS and not c.startswith("_")))


def union_of_keys(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.fillna("")


def compact_json(df: DataFrame, key: str) -> DataFrame:
    """key and a JSON text of the row without blank fields and internal columns."""
    cells = [F.nullif(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns if not c.startswith("_")]
    return df.select(key, F.to_json(F.struct(*cells)).alias("json"))


def prepare_export(df: DataFrame) -> DataFrame:
    """Without leftover index columns and with a first column files."""
    keep = [c for c in df.columns if c.strip() and not c.startswith("Unnamed:") and c != "files"]
    return df.select(col("files") if "files" in df.columns else F.lit("").alias("files"), *(col(c) for c in keep))


def language_column(df: DataFrame) -> str | None:
    return find_by_pattern(df.columns, r"^dc\.language")
