"""The generic record schema, blank values, role columns and target names."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The generic fields, in order, and those that curation adds.
GENERIC_FIELDS = ["id", "title", "author", "date", "description", "subject", "type", "subtitle", "issn", "doi", "isbn", "citation"]
CURATION_FIELDS = ["id", "title", "author", "description", "date", "type", "subject", "issn", "isbn", "doi", "citation", "rights", "rightsurl"]
ENRICHABLE_FIELDS = ["author", "date", "doi", "issn", "isbn", "citation", "subject", "type"]
CRITICAL_FIELDS = ["id", "title", "author", "date", "type"]
GENERIC_SCHEMA = T.StructType([T.StructField("_row_id", T.LongType()), *(T.StructField(f, T.StringType()) for f in GENERIC_FIELDS)])

ROW_ID = "_row_id"
_TARGET = re.compile(r"^([a-zA-Z0-9._-]+)(?:\[([a-zA-Z]{2})\])?$")


def col(name: str) -> Column:
    """A column by its literal name: target names have dots and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def ws_trim(c: Column) -> Column:
    """Without white space of any kind at the ends; F.trim takes spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, white space, or the words that stand for missing values, in any case."""
    return F.coalesce(c.rlike(r"(?U)^\s*+(?:(?i)nan|none)?+\s*+\z"), F.lit(True))  # ends at the first letter of a text


def is_empty_cell(c: Column) -> Column:
    """The stricter test of fills: null, or exactly one of three spellings."""
    return F.coalesce(c.isin("", "nan", "None"), F.lit(True))


def matches(pattern: str, name: str) -> bool:
    """Only an asterisk is a wildcard; brackets are literal."""
    return fnmatch.fnmatchcase(name, re.sub(r"([\[?])", r"[\1]", pattern))


def find_column(columns: Iterable[str], exact: Iterable[str] = (), prefixes: Iterable[str] = ()) -> str | None:
    """The first column, in their order, of one of these names or prefixes, whatever the case."""
    names, starts = {e.lower() for e in exact}, tuple(p.lower() for p in prefixes)
    return next((c for c in columns if c.strip().lower() in names or starts and c.strip().lower().startswith(starts)), None)


def find_by_pattern(columns: Iterable[str], pattern: str) -> str | None:
    return next((c for c in columns if re.search(pattern, c, re.IGNORECASE)), None)


def parse_target(name: str) -> tuple[str, str | None] | None:
    """Base field and language qualifier of a target name; None if it isn't one."""
    m = _TARGET.match(name.strip())
    return (m[1], m[2]) if m else None


def target_parts(name: str) -> tuple[str, str, str | None, str | None]:
    """schema, element, qualifier and language of ``schema.element.qualifier[lang]``."""
    base, _, rest = name.partition("[")
    schema, _, path = base.strip().partition(".")
    element, _, qualifier = path.partition(".")
    return schema, element, qualifier or None, rest.rstrip("]").strip() or None


def with_row_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """A surrogate that survives joins: 1, 2, ... by order_by where that is given, else 0, 1, ... in the order of the source's splits and
    of rows within them, the same whenever a split is read again. Only the sizes of splits (a row each) are shared."""
    if order_by is not None:
        return dense_numbers(df, order_by, ROW_ID)
    from pyspark.sql import Window

    numbered = df.withColumn("__m", F.monotonically_increasing_id())  # the split above bit 33, the place below
    split = F.shiftright("__m", 33)
    sizes = numbered.select(split.alias("__split")).groupBy("__split").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__split", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"))
    joined = numbered.join(F.broadcast(shifts), split == F.col("__split"))
    return joined.withColumn(ROW_ID, (F.col("__shift") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__m", "__split", "__shift")


def dense_numbers(df: DataFrame, order_by: str, to: str) -> DataFrame:
    """1, 2, ... in the order of a unique column, without one task for all rows: rows are dealt by range, numbered within
    their part, and moved up by the sizes of the parts before (a row per part)."""
    from pyspark.sql import Window

    dealt = df.repartitionByRange(col(order_by)).withColumn("__part", F.spark_partition_id())
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(col(order_by))))
    sizes = local.groupBy("__part").agg(F.max("__n").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"))
    return local.join(shifts, "__part").withColumn(to, (F.col("__n") + F.col("__shift")).cast("long")).drop("__part", "__n", "__size", "__shift")


def checkpoint_folder(spark) -> str:
    """The folder that the session names for checkpoints; one below its warehouse, which executors share too, if it names none."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read again, for loops whose plans would grow without end."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
