"""Input checks: keys, roles, structure and facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import col, dense_numbers, find_column, is_blank, ws_trim

#: Names by which a role is recognised: exact ones, and prefixes.
ROLES = {
    "title": (["title", "dc.title", "titulo", "título", "item title", "item_title", "document title", "document_title", "article title", "article_title"], ["dc.title", "dcterms.title"]),
    "doi": (["doi", "item doi", "item_doi", "dc.identifier.doi", "article doi", "article_doi", "document doi", "document_doi"], ["dc.identifier.doi"]),
    "id": (
        ["id", "handle", "uri", "url", "pmid", "dc.identifier.uri", "sedici.identifier.other", "identifier", "item id", "item_id", "document id", "document_id"],
        ["dc.identifier.uri", "sedici.identifier.other"],
    ),
}
HABITUAL = ("author", "date", "issn", "type")
#: Names of a key column, in the order in which they are tried.
KEY_NAMES = ["id", "sedici.identifier.other", "dc.identifier.uri", "doi", "pmid", "handle", "url", "uri"]


class InvalidInput(ValueError):
    """An input that later steps can't use."""


def key_test(df: DataFrame, columns: Sequence[str], slack: float = 0.1) -> DataFrame:
    """column, rows, distinct_values, blanks and is_key of all candidate columns. One pass makes a sketch of each column's values (a
    row a task, 16 KB a column at most). Where there are blanks, or the estimate is further below the rows than slack, many times the
    sketch's error, a column is no key, and its distinct values are the sketch's estimate (exact is false); the others alone are
    counted exactly."""
    rough = _rough(df, columns)
    likely = [c for c in columns if _may_be_key(rough, c, slack)]
    exact = _distinct(df, likely)
    found = [(c, rough["rows"], exact.get(c, rough[c][1]), rough[c][0], c in exact, rough["rows"] > 0 and exact.get(c) == rough["rows"]) for c in columns]
    return df.sparkSession.createDataFrame(found, "column string, rows long, distinct_values long, blanks long, exact boolean, is_key boolean")


def _rough(df: DataFrame, columns: Sequence[str]) -> dict:
    """Rows, and of each column the blanks and the estimate of distinct values."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = ws_trim(col(c).cast("string"))
        aggs += [F.count_if(is_blank(v)).alias(f"b{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(v, 14)).alias(f"d{i}")]
    one = df.agg(*aggs).first()
    return {"rows": one.n} | {c: (one[f"b{i}"], int(one[f"d{i}"] or 0)) for i, c in enumerate(columns)}


def _may_be_key(rough: dict, column: str, slack: float) -> bool:
    blanks, distinct = rough[column]
    return rough["rows"] > 0 and not blanks and distinct >= (1 - slack) * rough["rows"]


def _distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact numbers of distinct values, column by column: each is one grouped count, which tasks combine before they shuffle."""
    return {c: df.select(ws_trim(col(c).cast("string")).alias("v")).where("v is not null").distinct().count() for c in columns}


def discover_key(df: DataFrame, slack: float = 0.1) -> str | None:
    """The first candidate column that is a key; columns of DOIs are no candidates. Candidates that the sketch leaves are counted in
    order until one is a key."""
    names = [c for c in df.columns if "doi" not in c.lower() and any(k in c.lower() for k in ("id", "uuid", "handle"))]
    rough = _rough(df, names) if names else {}
    return next((c for c in names if _may_be_key(rough, c, slack) and _distinct(df, [c])[c] == rough["rows"]), None)


def keyed_table(df: DataFrame, order_by: str) -> tuple[DataFrame, str]:
    """df with a key and the key's name: the one that it has, else an injected one."""
    if found := discover_key(df):
        return df, found
    out = inject_key(df, order_by)
    return out, out.columns[0]


def inject_key(df: DataFrame, order_by: str) -> DataFrame:
    """A first column of 1..N in the order of order_by, named id, or synthetic_id where there is an id."""
    name = "synthetic_id" if "id" in df.columns else "id"
    numbered = dense_numbers(df, order_by, name)
    return numbered.select(F.col(name).cast("string").alias(name), *(col(c) for c in df.columns))


def check_source(df: DataFrame) -> list[str]:
    """Raises for an empty table or one without title and DOI; returns warnings about habitual columns that are missing."""
    if df.isEmpty():
        raise InvalidInput("no rows")
    if not any(find_column(df.columns, *ROLES[r]) for r in ("title", "doi")):
        raise InvalidInput("neither a title nor a DOI column")
    return [f"no column for {h}" for h in HABITUAL if not any(h in c.lower() for c in df.columns)]


def check_repository(df: DataFrame) -> None:
    for role in ("title", "id"):
        if not find_column(df.columns, *ROLES[role]):
            raise InvalidInput(f"no {role} column")


def resolve_key(columns: Sequence[str], mapped: str | None = None) -> str | None:
    """The first existing part of the mapped key, else the first usual name that is there, in any case."""
    for part in (mapped or "").split("+"):
        if part.strip() in columns:
            return part.strip()
    by_name = {c.lower(): c for c in columns}
    return next((by_name[k] for k in KEY_NAMES if k in by_name), None)


def integrity(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: whether a change kept the number of rows, all columns and all ids."""
    ids = before.select(ws_trim(col(key).cast("string")).alias("k")).distinct()
    lost = ids.join(after.select(ws_trim(col(key).cast("string")).alias("k")), "k", "left_anti").agg(F.count("*").alias("lost_ids"))
    counts = before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after"))).crossJoin(lost)  # three single rows
    missing = len(set(before.columns) - set(after.columns))
    return counts.withColumn("lost_columns", F.lit(missing).cast("long")).withColumn("valid", (F.col("rows_before") == F.col("rows_after")) & (F.col("lost_ids") == 0) & F.lit(missing == 0))


def commit_or_rollback(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The changed table if it is sound, else the one before."""
    return after if integrity(before, after, key).first().valid else before


def catalog_facets(catalog: DataFrame) -> DataFrame:
    """The facets of a target catalog: all fields, those that allow a language, and their base names (schema and element)."""
    base = F.substring_index("field", ".", 2)
    facets = F.array_compact(F.array(F.struct(F.lit("field").alias("facet"), F.col("field")), F.struct(F.lit("base").alias("facet"), base.alias("field")), F.when(F.col("allow_lang"), F.struct(F.lit("with_language").alias("facet"), F.col("field")))))
    return catalog.select(F.explode(facets).alias("x")).select("x.facet", "x.field").distinct()
