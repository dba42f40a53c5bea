"""Sources: delimited files, JSON pages, binary objects and paged services."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import SPANISH_MONTHS, split_values
from ..schema import col

PDF_COLUMNS = ["id", "title", "author", "date", "description", "subject", "type", "subtitle", "issn", "doi", "isbn", "citation", "source_file", "error"]


def detect_delimiter(spark: SparkSession, path: str, size: int = 4096) -> str:
    """From the first characters of the first lines, read by Spark so that any store will do; a comma if in doubt."""
    sample = "\n".join(r.value for r in spark.read.text(path).limit(40).collect())[:size].lstrip("﻿")
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_records(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as text; quoted fields may hold line feeds; a byte order mark is dropped. Files with line feeds in fields
    can't be split, so keep a Parquet copy of large ones."""
    sep = delimiter or detect_delimiter(spark, path)
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return df.toDF(*names).select(*(col(c) for c in names if c)).na.fill("")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return read_records(spark, path)
    except Exception as e:  # a file that isn't there is an empty table here, by contract
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def header(df: DataFrame) -> list[str]:
    return [c.strip() for c in df.columns if c.strip()]


def line_fields(line: Column, delimiter: str = ",") -> Column:
    """The fields of one line, however many; quoted ones may hold delimiters and doubled quotes."""
    sep = "\\Q" + delimiter + "\\E"
    plain = f"(?:(?!{sep}).)*+"
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f'(?s){sep}("(?:[^"]++|"")*+"|{plain})'), F.lit(1))
    return F.transform(found, lambda v: F.when(v.startswith('"') & v.endswith('"') & (F.length(v) > 1), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))


def merge_surplus(line: Column, fields: int, delimiter: str = ",") -> Column:
    """Fields of a broken line with too many: the surplus ones belong to the first."""
    cells = line_fields(line, delimiter)
    extra = F.size(cells) - fields
    head = F.array_join(F.slice(cells, F.lit(1), extra + 1), delimiter)
    return F.when(extra > 0, F.concat(F.array(head), F.slice(cells, extra + 2, F.lit(fields)))).otherwise(cells)


def list_objects(spark: SparkSession, path: str, suffix: str = ".pdf", prefix: str = "") -> DataFrame:
    """Objects of a store by suffix and prefix of their names, at any depth; content is read only if used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*{suffix}").load(path)
    return df.select("path", "length", "content")


def extract_objects(objects: DataFrame, extractor: Callable[[bytes], dict]) -> tuple[DataFrame, DataFrame]:
    """Records and failures of an extractor (a function of bytes to fields), run in Arrow batches; lists are joined by bars."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = extractor(content)
                    rows.append({c: ("|".join(map(str, v)) if isinstance(v := found.get(c, ""), list) else str(v or "")) for c in PDF_COLUMNS} | {"source_file": path, "error": ""})
                except Exception as e:  # one bad object must not end the run: it becomes a failure row
                    rows.append(dict.fromkeys(PDF_COLUMNS, "") | {"source_file": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=PDF_COLUMNS)

    out = objects.mapInPandas(step, ", ".join(f"{c} string" for c in PDF_COLUMNS))
    return out.where("error = ''").drop("error"), out.where("error != ''").select("source_file", "error")


def page_text(content: bytes, pages: Callable[[bytes, int], list[str]], ocr: Callable[[bytes, int], list[str]], limit: int = 3000) -> str:
    """Text of an object, for an extractor: that of the first three pages, else what is recognised on the first two; the first
    limit characters, which is what models are shown. Both readers take the content and a number of pages."""
    text = "\n".join(pages(content, 3)).strip() or "\n".join(ocr(content, 2)).strip()
    return text[:limit]


def ingest(spark: SparkSession, path: str, extractor: Callable[[bytes], dict] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Records and, of objects, failures: with an extractor the objects below a path, else a delimited file."""
    if extractor:
        return extract_objects(list_objects(spark, path), extractor)
    return read_records(spark, path), None


def flatten_articles(pages: DataFrame) -> DataFrame:
    """Harvested articles (struct column bib): ten flat columns; the month as a number, the first DOI, the first full text link."""
    bib = F.col("bib")
    kind = lambda xs, name: F.get(F.filter(xs, lambda x: x["type"] == name), F.lit(0))
    month = F.lower(bib["month"])
    number = F.coalesce(F.create_map(*(F.lit(x) for kv in SPANISH_MONTHS.items() for x in kv))[month], F.lpad(month, 2, "0"))
    return pages.select(
        bib["title"].alias("title"), F.array_join(F.transform(bib["author"], lambda a: a["name"]), "|").alias("author"), bib["year"].alias("year"), number.alias("month"), bib["abstract"].alias("abstract"),
        kind(bib["identifier"], "doi")["id"].alias("doi"), kind(bib["identifier"], "eissn")["id"].alias("issn"), kind(bib["link"], "fulltext")["url"].alias("url"), bib["journal"]["title"].alias("journal"), F.array_join(bib["keywords"], "|").alias("keywords"),
    )


def fetched(call: Callable[[], object], missing: object, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> object:
    """What a call to a service returns: three attempts, apart by 2 to 10 seconds; FileNotFoundError (no such record) gives missing
    at once, other errors than lost connections are raised."""
    for attempt in range(attempts):
        try:
            return call()
        except FileNotFoundError:
            return missing
        except (ConnectionError, TimeoutError):
            if attempt == attempts - 1:
                raise
            wait(min(2 ** (attempt + 1), 10))
    return missing


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """A paged service as a source: ``spark.read.format("paged").option("fetch", "module:function")``. The function takes a page
    number and a size and returns rows; each page is a partition, fetched by an executor with three attempts."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("schema", "page int, json string")

    def reader(self, schema) -> "PagedReader":
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.size, self.rows = options["fetch"], min(int(options.get("size", 100)), 100), int(options.get("rows", 1000))

    def partitions(self) -> list[_Page]:
        return [_Page(i) for i in range(-(-self.rows // self.size))]

    def read(self, partition: _Page):
        import importlib
        import json

        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        rows = fetched(lambda: fetch(partition.number, self.size), missing=[])
        for row in rows[: max(0, self.rows - partition.number * self.size)]:
            yield partition.number, json.dumps(row)


def dedup_export(df: DataFrame, source: str) -> DataFrame:
    """source, title, id (DOI, else identifier), author (each ended by a semicolon) and date (year) of full export rows."""
    ident = F.coalesce(F.nullif(F.trim("doi"), F.lit("")), F.col("identifier"))
    authors = F.array_join(F.transform(split_values(col("creators"), "|"), lambda a: F.concat(a, F.lit(";"))), " ")
    return df.select(F.lit(source).alias("source"), "title", ident.alias("id"), authors.alias("author"), F.substring("publicationDate", 1, 4).alias("date"))


#: The columns of a full export, in order.
EXPORT_COLUMNS = ["identifier", "title", "doi", "publicationDate", "publicationName", "publisher", "publicationType", "openaccess", "subject", "keyword", "abstract", "creators", "url"]


def full_export(records: DataFrame) -> DataFrame:
    """Service records flattened to EXPORT_COLUMNS: subjects and keywords (arrays) joined by a bar between blanks, each non-blank
    creator ended by a semicolon, the first address. A column that is missing is empty."""
    names = F.filter(F.transform("creators", lambda c: F.trim(c["creator"])), lambda v: v != "")
    made = {
        "subject": lambda: F.array_join("subject", " | "),
        "keyword": lambda: F.array_join("keyword", " | "),
        "creators": lambda: F.array_join(F.transform(names, lambda v: F.concat(v, F.lit(";"))), " "),
        "url": lambda: F.get(col("url"), F.lit(0))["value"],
    }
    cell = lambda c: F.lit("") if c not in records.columns else F.coalesce(made.get(c, lambda: col(c).cast("string"))(), F.lit(""))
    return records.select(*(cell(c).alias(c) for c in EXPORT_COLUMNS))
