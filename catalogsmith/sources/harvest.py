"""A paged service as a source whose size is learned: ``spark.read.format("harvest").option("fetch", "module:function")``.

The function takes (start, size, wanted) and returns {"total": how many rows there are, "records": some of them, from start on};
wanted holds equalities (column to value) that the query asks for, if the source is told that the service can filter by these.
Planning fetches the first page, learns the total and deals all pages to tasks, which fetch with three attempts each.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .readers import fetched


@dataclass
class Pages(InputPartition):
    first: int
    until: int
    known: list = field(default_factory=list)  # of the first page, which planning has fetched

    def __post_init__(self) -> None:
        super().__init__(self.first)


class HarvestSource(DataSource):
    """Options: fetch; size (rows of a page, 100); from (rows to pass over, 0: where an earlier harvest ended); rows (at most; all, if
    unset); tasks (at most, 200); filters (columns that the service filters by, apart by commas); schema ("position long, json
    string" unless given: other columns are fields of the record, as text)."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return self.options.get("schema", "position long, json string")

    def reader(self, schema) -> "HarvestReader":
        return HarvestReader(dict(self.options), schema)


class HarvestReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.fetch, self.size, self.begin = options["fetch"], int(options.get("size", 100)), int(options.get("from", 0))
        self.rows, self.tasks = options.get("rows"), int(options.get("tasks", 200))
        self.names, self.wanted = [f.name for f in schema.fields], {}
        self.filterable = {c.strip() for c in options.get("filters", "").split(",") if c.strip()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.filterable and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def _page(self, start: int, size: int) -> dict:
        module, _, name = self.fetch.partition(":")
        call = getattr(importlib.import_module(module), name)
        return fetched(lambda: call(start, size, dict(self.wanted)), missing={"total": 0, "records": []})

    def partitions(self) -> list[Pages]:
        most = int(self.rows) if self.rows is not None else None
        size = self.size if most is None else min(self.size, most)
        if not size:
            return [Pages(0, 0)]
        first = self._page(self.begin, size)
        end = int(first["total"]) if most is None else min(int(first["total"]), self.begin + most)
        pages = -(-max(0, end - self.begin) // self.size)
        each = max(1, -(-pages // self.tasks)) * self.size
        out = [Pages(k, min(k + each, end)) for k in range(self.begin, end, each)] or [Pages(self.begin, self.begin)]
        out[0].known = list(first["records"])[: max(0, end - self.begin)]
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        at, known = partition.first, partition.known
        while at < partition.until:
            records = known or self._page(at, min(self.size, partition.until - at))["records"]
            known = []
            if not records:
                return  # the service has fewer by now
            for record in records[: partition.until - at]:
                text = {k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in record.items()}
                yield tuple(at if n == "position" else json.dumps(record, ensure_ascii=False) if n == "json" else text.get(n) for n in self.names)
                at += 1


def harvest(spark: SparkSession, fetch: str, **options: object) -> DataFrame:
    """A harvest as a table; options as of HarvestSource (begin for from). Its equalities reach the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HarvestSource)
    reader = spark.read.format("harvest").option("fetch", fetch)
    for name, value in options.items():
        reader = reader.option({"begin": "from"}.get(name, name), str(value))
    return reader.load()
