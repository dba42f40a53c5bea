"""Enrichment from provider tables: a chain in which the first provider with a result wins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers as services
from ..functions import text as t
from ..schema import col, is_blank, is_empty_cell

#: Payload keys and the generic fields that they fill.
GENERIC_KEYS = {
    "title": "title", "authors": "author", "year": "date", "doi": "doi", "type": "type", "journal": "citation", "issn": "issn",
    "abstract_es": "description", "abstract_en": "description", "subjects": "subject", "isbn": "isbn",
}
#: Payload keys and the target columns that they fill; {local} is the repository's own schema.
TARGET_KEYS = {
    "title": "dc.title", "authors": "{local}.creator.person", "year": "dc.date.issued", "doi": "{local}.identifier.other", "type": "dc.type",
    "journal": "{local}.relation.journalTitle", "issn": "{local}.identifier.issn", "abstract_es": "dc.abstract[es]", "abstract_en": "dc.abstract[en]",
    "pages": "dc.format.extent", "language": "dc.language", "subjects": "{local}.subject.materias", "publisher": "dc.publisher",
    "volume_and_issue": "{local}.relation.journalVolumeAndIssue", "isbn": "{local}.identifier.isbn",
}
#: The services in the order in which they are trusted, and the key that each is asked by.
CHAIN = [("crossref", "doi"), ("csl", "doi"), ("openalex", "issn"), ("openalex", "title"), ("openlibrary", "isbn")]
#: Key columns by which providers are asked, and how each is normalised.
KEYS: dict[str, Callable[[Column], Column]] = {"doi": lambda c: F.lower(t.clean_doi(c)), "issn": t.clean_issn, "isbn": t.clean_isbn, "title": lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))}


@dataclass(frozen=True)
class Provider:
    """A table of payloads asked by one key; an unavailable one is left out of the plan."""

    name: str
    key: str
    table: DataFrame
    available: bool = True


_factories: dict[str, Callable[..., Provider]] = {}


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    _factories[name] = factory


def create_provider(name: str, *args: object) -> Provider:
    return _factories[name](*args)


def generic_payload(df: DataFrame, keys: Mapping[str, str] = GENERIC_KEYS) -> DataFrame:
    """The generic fields of payload rows: of several keys for one field the last non-empty counts."""
    by_field: dict[str, list[str]] = {}
    for k, f in keys.items():
        if k in df.columns:
            by_field.setdefault(f, []).append(k)
    own = [c for c in df.columns if c not in keys]
    return df.select(*(col(c) for c in own), *(F.coalesce(*(F.nullif(col(k).cast("string"), F.lit("")) for k in reversed(ks))).alias(f) for f, ks in by_field.items()))


def target_payload(df: DataFrame, local: str = "local") -> DataFrame:
    """The target columns of payload rows; keys that have none are left out, and so are empty values (null)."""
    names = {k: c.format(local=local) for k, c in TARGET_KEYS.items()}
    return df.select(*(col(c) for c in df.columns if c not in names and c not in ("open_access", "citations")), *(F.nullif(col(k).cast("string"), F.lit("")).alias(c) for k, c in names.items() if k in df.columns))


def service_table(responses: DataFrame, service: str, key: str, json: str = "json") -> DataFrame:
    """Stored responses of a service (the key that it was asked by, and its JSON) as payload rows of generic fields, with that key;
    responses that can't be read, or hold nothing, are left out."""
    parsed = responses.select(col(key).cast("string").alias("__key"), services.PARSERS[service](col(json)).alias("x")).select("__key", "x.*")
    full = generic_payload(parsed)
    found = F.greatest(*(F.length(F.coalesce(col(f), F.lit(""))) for f in full.columns if f not in ("__key", "type")), F.lit(0))
    fields = [f for f in full.columns if f not in ("__key", key)]
    return full.where(found > 0).select(F.col("__key").alias(key), *(col(f) for f in fields))


def default_chain(responses: Mapping[str, DataFrame], health: Mapping[str, bool] | None = None, json: str = "json") -> list[Provider]:
    """The usual chain over stored responses: tables by service, each with a column of JSON and the key columns that it was asked by.
    A service without a table is left out; one that health calls down is unavailable."""
    known = {(s, k) for s, df in responses.items() for k in df.columns}
    return [Provider(s, k, service_table(responses[s], s, k, json), (health or {}).get(s, True)) for s, k in CHAIN if (s, k) in known]


def enrich_by(df: DataFrame, key: str, responses: Mapping[str, DataFrame], fields: Sequence[str], json: str = "json") -> DataFrame:
    """The part of the usual chain that asks by one key: doi, issn, isbn or title."""
    return chain(df, [p for p in default_chain(responses, json=json) if p.key == key], fields)


def chain(df: DataFrame, providers: Sequence[Provider], fields: Sequence[str]) -> DataFrame:
    """Blank cells of fields from the first provider that knows the record; provider names it (null: none). Each provider is
    one left join on its key; of several payloads of a key the fullest counts (the least of these, if several are)."""
    out, hits = df, []
    for i, p in enumerate(q for q in providers if q.available and q.key in df.columns):
        norm = KEYS.get(p.key, lambda c: c)
        have = [f for f in fields if f in p.table.columns]
        payload = F.struct(*(col(f).cast("string").alias(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields))
        one = p.table.select(norm(col(p.key)).alias(f"__k{i}"), payload.alias("x")).where(f"__k{i} != ''").withColumn("n", sum((F.when(is_empty_cell(F.col("x")[f]), 0).otherwise(1) for f in fields), F.lit(0))).groupBy(f"__k{i}").agg(F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"].alias(f"__x{i}"))
        out = out.join(one, norm(col(p.key)) == F.col(f"__k{i}"), "left") if f"__k{i}" not in out.columns else out
        hits.append((p.name, f"__x{i}"))
    if not hits:
        return df.withColumn("provider", F.lit(None).cast("string"))
    won = F.coalesce(*(F.col(x) for _, x in hits))
    name = F.coalesce(*(F.when(F.col(x).isNotNull(), F.lit(n)) for n, x in hits))
    cells = [F.when(is_empty_cell(col(f)) & ~is_empty_cell(won[f]), won[f]).otherwise(col(f)).alias(f) if f in fields else col(f) for f in df.columns]
    new = [won[f].alias(f) for f in fields if f not in df.columns]
    return out.select(*cells, *new, name.alias("provider"))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~is_blank(c), c) for c in columns))


def counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(F.coalesce("provider", F.lit("none")).alias("provider")).agg(F.count("*").alias("n"))


def tier(df: DataFrame, fields: Sequence[str], gold: float = 0.9, silver: float = 0.6) -> Column:
    """gold, silver or bronze by the share of filled fields."""
    share = sum((~is_blank(col(f))).cast("int") for f in fields) / len(fields)
    return F.when(share >= gold, "gold").when(share >= silver, "silver").otherwise("bronze")
