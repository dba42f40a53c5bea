"""Context of an error from its message: class, quoted literals, and the column that they come from."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import col

#: Words of messages that point to a column, in the order in which they count, and names of months.
KEYWORDS = {"date": ["fecha", "date", "year", "año"], "author": ["autor", "author", "creator"], "title": ["titulo", "title"]}
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
#: Lines of a file that are looked at, its header among them.
LINES = 50


def error_class(message: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(message, r"\b([A-Z][a-zA-Z]+Error)\b", 1), F.lit("")), F.lit("UnknownError"))


def quoted_literals(message: Column) -> Column:
    """Trimmed texts between quotes, of 1 to 49 characters, in order."""
    found = F.transform(F.regexp_extract_all(message, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(found, lambda x: (x != "") & (F.length(x) < 50))


def keyword_column(message: Column, literals: Column) -> Column:
    """The column that a message's words point to; empty if none do."""
    low = F.lower(message)
    says = lambda name: F.exists(F.array(*map(F.lit, KEYWORDS[name])), lambda w: F.contains(low, w))
    month = F.exists(literals, lambda x: F.lower(x).isin(*MONTHS))
    return F.when(says("date") | month, "date").when(says("author"), "author").when(says("title"), "title").otherwise("")


def first_cells(table: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """pos, column and value (lower case) of the non-empty cells of the first rows, numbered along rows and then columns."""
    head = table.orderBy(col(order_by)).limit(LINES - 1).select(*(col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)), col(order_by).alias("__o"))
    rows = head.agg(F.array_sort(F.collect_list(F.struct("__o", F.array(*(F.col(f"c{i}") for i in range(len(columns)))).alias("v")))).alias("rows"))  # LINES rows at most
    cells = rows.select(F.posexplode("rows").alias("row", "x")).select("row", F.posexplode("x.v").alias("i", "value"))
    named = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)
    return cells.where("value != ''").select((F.col("row") * len(columns) + F.col("i")).alias("pos"), named.alias("column"), F.lower("value").alias("value"))


def first_holding(literals: Column, cells: DataFrame) -> Column:
    """The column of the first cell that holds any of the literals, whatever the case; null if none does. The cells, a bounded number,
    go to the tasks, and each batch is searched with one automaton of all its literals, which passes every cell once."""
    held = [(r["column"], r["value"]) for r in cells.orderBy("pos").collect()]

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        for asked in batches:
            wanted = {w for ws in asked if ws is not None for x in ws if (w := x.lower())}
            first: dict[str, int] = {}
            if wanted:
                automaton = ahocorasick.Automaton()
                for w in wanted:
                    automaton.add_word(w, w)
                automaton.make_automaton()
                for i, (_, value) in enumerate(held):
                    for _, w in automaton.iter(value):
                        first.setdefault(w, i)
            at = (min((first[x.lower()] for x in ws if x.lower() in first), default=None) if ws is not None else None for ws in asked)
            yield pd.Series([held[i][0] if i is not None else None for i in at], dtype=object)

    return find(literals)


def error_context(errors: DataFrame, message: str, table: DataFrame | None = None, columns: list[str] | None = None, order_by: str = "_row_id") -> DataFrame:
    """errors with error_class, sample_tokens and affected_column: the column of the first cell, among the first lines of a table in
    its order, that holds a quoted literal; else the column that words of the message point to; else empty. A null message is an
    empty one."""
    text = F.coalesce(col(message), F.lit(""))
    out = errors.withColumn("error_class", error_class(text)).withColumn("sample_tokens", quoted_literals(text))
    found = F.lit(None).cast("string")
    if table is not None:
        found = first_holding(F.col("sample_tokens"), first_cells(table, columns or [c for c in table.columns if c != order_by], order_by))
    return out.withColumn("affected_column", F.coalesce(found, keyword_column(text, F.col("sample_tokens"))))
