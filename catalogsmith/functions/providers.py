"""Records of bibliographic services, from their JSON to one set of fields, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands between authors.
BETWEEN = " || "
#: Fixed value: a year in a free date.
BOOK_YEAR = r"(\d{4})"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _listed(values: Column, of: Callable[[Column], Column], between: str = BETWEEN) -> Column:
    """The non-empty values of a list, joined; a missing list is empty."""
    return F.coalesce(F.array_join(F.filter(F.transform(values, lambda x: of(x)), lambda v: v != ""), between), F.lit(""))


def _one_or_first(c: Column, field: str) -> Column:
    """A field that holds a text, or a list of texts of which the first counts."""
    return F.coalesce(F.get_json_object(c, f"$.{field}[0]"), F.get_json_object(c, f"$.{field}"))


def crossref(c: Column) -> Column:
    """A work of a DOI registry; absent fields are empty."""
    w = F.from_json(
        c,
        "title array<string>, author array<struct<family:string,given:string>>, published struct<`date-parts`:array<array<string>>>, ISSN array<string>, "
        "publisher string, type string, abstract string, `container-title` array<string>",
    )
    first = lambda x: _or_empty(F.get(x, F.lit(0)))
    return F.struct(
        first(w["title"]).alias("title"),
        _listed(w["author"], lambda a: F.btrim(F.concat(_or_empty(a["family"]), F.lit(", "), _or_empty(a["given"])), F.lit(", "))).alias("authors"),
        first(F.get(w["published"]["date-parts"], F.lit(0))).alias("year"),
        _or_empty(w["publisher"]).alias("publisher"),
        first(w["ISSN"]).alias("issn"),
        _or_empty(w["type"]).alias("type"),
        _or_empty(w["abstract"]).alias("abstract_en"),
        first(w["container-title"]).alias("journal"),
    )


def openalex(c: Column) -> Column:
    """A work of a scholarly graph; absent fields are empty."""
    w = F.from_json(
        c,
        "title string, authorships array<struct<author:struct<display_name:string>>>, publication_year string, doi string, type string, cited_by_count string, "
        "primary_location struct<source:struct<display_name:string,issn_l:string>>, open_access struct<is_oa:boolean>",
    )
    source, free = w["primary_location"]["source"], w["open_access"]["is_oa"]
    return F.struct(
        _or_empty(w["title"]).alias("title"),
        _listed(w["authorships"], lambda a: _or_empty(a["author"]["display_name"])).alias("authors"),
        _or_empty(w["publication_year"]).alias("year"),
        _or_empty(w["doi"]).alias("doi"),
        _or_empty(w["type"]).alias("type"),
        _or_empty(source["display_name"]).alias("journal"),
        _or_empty(source["issn_l"]).alias("issn"),
        F.when(free, "True").when(~free, "False").otherwise("").alias("open_access"),
        _or_empty(w["cited_by_count"]).alias("citations"),
    )


def csl(c: Column) -> Column:
    """A citation as DOI resolvers give it; absent fields are null, but authors and year empty."""
    w = F.from_json(
        c,
        "author array<struct<family:string,given:string,literal:string>>, issued struct<`date-parts`:array<array<string>>>, volume string, issue string, "
        "publisher string, page string, DOI string, type string, language string, abstract string",
    )
    name = lambda a: F.coalesce(F.nullif(a["literal"], F.lit("")), F.btrim(F.concat(_or_empty(a["given"]), F.lit(" "), _or_empty(a["family"]))))
    part = lambda field, sign: F.concat(F.lit(sign), F.nullif(w[field], F.lit("")))
    return F.struct(
        _one_or_first(c, "title").alias("title"),
        _listed(w["author"], name).alias("authors"),
        _or_empty(F.get(F.get(w["issued"]["date-parts"], F.lit(0)), F.lit(0)).try_cast("int")).alias("year"),
        w["publisher"].alias("publisher"),
        _one_or_first(c, "container-title").alias("journal"),
        F.nullif(F.concat_ws(", ", part("volume", "vol. "), part("issue", "no. ")), F.lit("")).alias("volume_and_issue"),
        w["page"].alias("pages"),
        w["DOI"].alias("doi"),
        w["type"].alias("type"),
        w["language"].alias("language"),
        w["abstract"].alias("abstract_en"),
    )


def openlibrary(c: Column) -> Column:
    """A book by ISBN; at most ten subjects, as the service's own contract has it."""
    named = "array<struct<name:string>>"
    w = F.from_json(c, f"title string, subtitle string, authors {named}, publishers {named}, subjects {named}, publish_date string, number_of_pages string")
    names = lambda field: F.filter(F.transform(w[field], lambda x: x["name"]), lambda v: v != "")
    return F.struct(
        F.nullif(F.concat(_or_empty(w["title"]), F.coalesce(F.concat(F.lit(": "), F.nullif(w["subtitle"], F.lit(""))), F.lit(""))), F.lit("")).alias("title"),
        F.coalesce(F.array_join(names("authors"), BETWEEN), F.lit("")).alias("authors"),
        F.get(names("publishers"), F.lit(0)).alias("publisher"),
        F.regexp_extract(_or_empty(w["publish_date"]), BOOK_YEAR, 1).alias("year"),
        F.nullif(F.nullif(w["number_of_pages"], F.lit("0")), F.lit("")).alias("pages"),
        F.coalesce(F.array_join(F.slice(names("subjects"), 1, 10), ", "), F.lit("")).alias("subjects"),
        F.lit("Libro").alias("type"),
    )


PARSERS: dict[str, Callable[[Column], Column]] = {"crossref": crossref, "openalex": openalex, "csl": csl, "openlibrary": openlibrary}
