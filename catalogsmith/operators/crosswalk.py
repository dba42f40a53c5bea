"""Crosswalks: a declarative mapping of columns, compiled to one projection."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rewrite_separator, split_values, unescaped
from ..schema import CRITICAL_FIELDS, GENERIC_FIELDS, col, is_blank, matches, parse_target, ws_trim


@dataclass(frozen=True)
class Mapping:
    """left: a column, ``a+b``, ``prefix*`` or ``a*+b*``; replace: the column it becomes."""

    left: str
    replace: str
    default: str | None = ""
    required: bool = False
    filter: str = ""

    @property
    def parts(self) -> list[str]:
        return [p.strip() for p in self.left.split("+") if p.strip()]

    @property
    def is_wildcard(self) -> bool:
        return "*" in self.left


@dataclass(frozen=True)
class Settings:
    original_separator: str = "||"
    replace_separator: str = "|"
    file_delimiter: str = ","
    separator_regex: str | None = None


@dataclass(frozen=True)
class Crosswalk:
    mappings: tuple[Mapping, ...]
    settings: Settings = field(default_factory=Settings)

    @staticmethod
    def load(source: object) -> "Crosswalk":
        """From a path, a mapping of both parts, ``[mappings, settings]``, ``[mappings]`` or a flat list of mappings."""
        data = json.loads(open(source, encoding="utf-8").read()) if isinstance(source, str) else source
        if isinstance(data, dict):
            rows, settings = data.get("mappings", []), data.get("settings", {})
        elif data and isinstance(data[0], list):
            rows, settings = data[0], data[1] if len(data) > 1 else {}
        else:
            rows, settings = data, {}
        own = {k: v for k, v in settings.items() if k in Settings.__dataclass_fields__}
        keep = Mapping.__dataclass_fields__
        return Crosswalk(tuple(Mapping(**{k: v for k, v in row.items() if k in keep}) for row in rows), Settings(**own))

    def dump(self) -> str:
        settings = {k: v for k, v in vars(self.settings).items() if v is not None}
        return json.dumps([[vars(m) for m in self.mappings], settings], ensure_ascii=False, indent=2)

    def expand(self, mapping: Mapping, columns: Sequence[str]) -> list[str]:
        """The existing columns that a mapping takes, in the order of its parts and then of the columns."""
        return list(dict.fromkeys(c for part in mapping.parts for c in columns if matches(part, c)))

    def used_columns(self, columns: Sequence[str]) -> list[str]:
        wanted = {c for m in self.mappings for c in self.expand(m, columns)}
        return [c for c in columns if c in wanted]

    def missing_columns(self, columns: Sequence[str]) -> list[str]:
        return [m.left for m in self.mappings if m.left and not self.expand(m, columns)]


def value_filters(c: Column, spec: str) -> Column:
    """``trim`` takes spaces and then commas off the ends; ``lowercase``; several apart by bars."""
    for name in filter(None, (s.strip() for s in spec.split("|"))):
        c = F.btrim(F.btrim(c, F.lit(" ")), F.lit(",")) if name == "trim" else F.lower(c) if name == "lowercase" else c
    return c


def combined(columns: Sequence[str], settings: Settings) -> Column:
    """One field of several: non-empty values, each with its separators rewritten, joined by the new separator."""
    sep = settings.replace_separator
    cells = [rewrite_separator(ws_trim(col(c).cast("string")), settings.original_separator, sep, settings.separator_regex) for c in columns]
    return unescaped(F.concat_ws(sep, *(F.nullif(F.btrim(x, F.lit(sep)), F.lit("")) for x in cells)))


def compile_mapping(mapping: Mapping, columns: Sequence[str], crosswalk: Crosswalk) -> Column:
    """The expression of one target column. A missing source column counts as empty."""
    found = crosswalk.expand(mapping, columns)
    value = value_filters(combined(found, crosswalk.settings), mapping.filter) if found else F.lit("")
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(mapping.default or "")).alias(mapping.replace)


def apply(df: DataFrame, crosswalk: Crosswalk, keep: Iterable[str] = ()) -> DataFrame:
    """All mappings as one select, so the scan reads only the columns that they name; rows with a blank required field go.
    Several mappings to one column coalesce in their order."""
    by_target: dict[str, list[Column]] = {}
    for m in crosswalk.mappings:
        by_target.setdefault(m.replace, []).append(compile_mapping(m, df.columns, crosswalk))
    fields = [F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit("")).alias(t) if len(cs) > 1 else cs[0] for t, cs in by_target.items()]
    out = df.select(*(col(k) for k in keep), *fields)
    for m in crosswalk.mappings:
        if m.required:
            out = out.where(~is_blank(col(m.replace)))
    return out


# Guardrails over mapping tables: DataFrames of (pos, left, replace)


def mapping_parts(mappings: DataFrame) -> DataFrame:
    return mappings.select("pos", "left", "replace", F.explode(F.transform(F.split("left", r"\+"), lambda x: F.trim(x))).alias("part")).where("part != ''")


def guard_base(mappings: DataFrame, header: DataFrame) -> DataFrame:
    """Mappings with both sides whose plain parts all exist; header: a column named column."""
    unknown = mapping_parts(mappings).where("part not like '%*%'").join(header, F.col("part") == F.col("column"), "left_anti").select("pos").distinct()
    return mappings.where("trim(left) != '' and trim(replace) != ''").join(unknown, "pos", "left_anti")


def guard_generic(mappings: DataFrame) -> DataFrame:
    return mappings.where(F.lower(F.trim("replace")).isin(*GENERIC_FIELDS))


def guard_target(mappings: DataFrame, catalog: DataFrame, fallback: str = "local.identifier.other") -> DataFrame:
    """Target names by grammar and catalog (field, allow_lang): a language that the field doesn't allow goes; an unknown name
    with an identifier in it becomes the fallback; others are dropped. action says which."""
    grammar = r"^([a-zA-Z0-9._-]+)(?:\[([a-zA-Z]{2})\])?$"
    base, lang = F.regexp_extract("replace", grammar, 1), F.regexp_extract("replace", grammar, 2)
    named = mappings.withColumn("base", base).withColumn("lang", lang).where("base != ''")
    known = named.join(catalog, F.col("base") == F.col("field"), "left")
    wanted = F.when(F.col("field").isNotNull() & (F.col("lang") != "") & ~F.col("allow_lang"), F.col("base")).when(F.col("field").isNotNull(), F.col("replace")).when(F.lower("base").rlike("identifier|id"), F.lit(fallback))
    action = F.when(F.col("field").isNull(), F.when(wanted.isNotNull(), "fallback").otherwise("dropped")).when(wanted != F.col("replace"), "stripped").otherwise("kept")
    return known.select("pos", "left", wanted.alias("replace"), action.alias("action"))


def compatibility(mappings: DataFrame, header: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each mapping as incompatible (a source column is missing), invalid (no such target) or valid."""
    missing = mapping_parts(mappings).where("part not like '%*%'").join(header, F.col("part") == F.col("column"), "left_anti").select("pos").distinct().withColumn("gone", F.lit(True))
    named = mappings.join(missing, "pos", "left").withColumn("base", F.regexp_extract("replace", r"^([^\[]+)", 1))
    known = named.join(catalog, F.col("base") == F.col("field"), "left")
    status = F.when(F.col("gone"), "incompatible").when(F.col("field").isNull(), "invalid").otherwise("valid")
    return known.select("pos", "left", "replace", status.alias("status"))


def met_parts(mappings: DataFrame, header: DataFrame) -> DataFrame:
    """Parts of mappings and the columns of the header that they name: by equality, or by a pattern in which asterisks match any
    text. Distinct patterns alone are compared with every column."""
    parts = mapping_parts(mappings)
    exact = parts.join(header, F.col("part") == F.col("column"))
    like = F.replace(F.replace(F.replace("part", F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))
    patterns = parts.where("contains(part, '*')").select(F.col("part").alias("pattern"), like.alias("like")).distinct()
    named = patterns.join(header, F.expr("column like like")).select("pattern", "column")
    return exact.union(parts.join(named, F.col("part") == F.col("pattern")).select(*exact.columns))


def drift(mappings: DataFrame, header: DataFrame) -> DataFrame:
    """What a cached configuration misses in a new header (a mapping is fine if any of its parts is there), and what columns of
    the header it does not name."""
    met = met_parts(mappings, header)
    missing = mappings.join(met.select("pos").distinct(), "pos", "left_anti").select(F.lit("missing").alias("kind"), F.col("left").alias("name"))
    unmapped = header.join(met.select("column").distinct(), "column", "left_anti").select(F.lit("unmapped").alias("kind"), F.col("column").alias("name"))
    return missing.unionByName(unmapped)


def compose(source: DataFrame, canonical: DataFrame) -> DataFrame:
    """Source-to-generic mappings followed by generic-to-target ones (field, target)."""
    return source.join(canonical, F.lower(F.trim(F.col("replace"))) == F.col("field")).select("pos", "left", F.col("target").alias("replace"))


def merged(*lists: DataFrame) -> DataFrame:
    """Mappings of several lists, the first of each left side; earlier lists come first."""
    from pyspark.sql import Window

    tagged = [df.select("pos", "left", "replace").withColumn("prio", F.lit(i)) for i, df in enumerate(lists)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    first = Window.partitionBy("left").orderBy("prio", "pos")
    return both.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def remnant_columns(header: DataFrame, mappings: DataFrame) -> DataFrame:
    """The columns of a header that no part of a mapping names."""
    return header.join(met_parts(mappings, header).select("column").distinct(), "column", "left_anti")


def remnants(columns: Sequence[str], crosswalk: Crosswalk) -> list[str]:
    used = set(crosswalk.used_columns(columns))
    return [c for c in columns if c not in used]


def fallback_mappings(columns: Sequence[str]) -> Crosswalk:
    """Each column that bears a generic name to that name."""
    return Crosswalk(tuple(Mapping(c, c.strip().lower()) for c in columns if c.strip().lower() in GENERIC_FIELDS))


def unsplit(df: DataFrame, columns: Sequence[str], separator: str = "|", longest: int = 40) -> DataFrame:
    """df with a column unsplit: the list fields among these with a part of over longest characters and fewer than three parts."""
    parts = {c: split_values(col(c), separator) for c in columns}
    flags = (F.when(F.exists(v, lambda p: F.length(p) > longest) & (F.size(v) < 3), F.lit(c)) for c, v in parts.items())
    return df.withColumn("unsplit", F.array_compact(F.array(*flags)) if parts else F.array().cast("array<string>"))


def smoke_test(df: DataFrame, crosswalk: Crosswalk, rows: int = 3) -> dict[str, list[str]]:
    """On a few rows (a preview by design): critical fields without a mapping (all, if no row comes out), and list fields that look
    unsplit."""
    targets = {m.replace.strip().lower() for m in crosswalk.mappings}
    preview = apply(df.limit(rows), crosswalk)
    lists = [c for c in ("author", "subject") if c in preview.columns]
    found = unsplit(preview, lists, crosswalk.settings.replace_separator).select("unsplit").collect()
    return {"missing": [f for f in CRITICAL_FIELDS if f not in targets or not found], "unsplit": [c for c in lists if any(c in r.unsplit for r in found)]}


def sound(check: dict[str, list[str]]) -> bool:
    return not any(check.values())


def target_name(name: str) -> str | None:
    return name if parse_target(name) else None
