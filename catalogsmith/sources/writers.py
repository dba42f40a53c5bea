"""Sinks: delimited files and import packages of one folder per item."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_letters
from ..schema import col, target_parts


def write_records(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header from the schema, so an empty table writes one too."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def schemas(columns: Sequence[str]) -> list[str]:
    """The metadata schemas of target names, in order; the text before the first dot."""
    return list(dict.fromkeys(target_parts(c)[0] for c in columns if "." in c))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def item_xml(columns: Sequence[str], schema: str, separator: str = "||") -> Column:
    """The metadata document of one schema for a row: a dcvalue for each non-empty value, in the order of columns and values."""
    lines = []
    for name in columns:
        own, element, qualifier, language = target_parts(name)
        if own != schema or "." not in name:
            continue
        attributes = f'element="{element}"' + (f' qualifier="{qualifier}"' if qualifier else "") + (f' language="{language}"' if language else "")
        values = F.filter(F.transform(F.split(F.coalesce(col(name), F.lit("")), "\\Q" + separator + "\\E"), lambda v: F.trim(v)), lambda v: v != "")
        lines.append(F.transform(values, _dcvalue(attributes)))
    head = "<dublin_core>" if schema == "dc" else f'<dublin_core schema="{schema}">'
    return F.array_join(F.concat(F.array(F.lit(head)), *lines, F.array(F.lit("</dublin_core>"))), "\n")


def _dcvalue(attributes: str):
    return lambda v: F.concat(F.lit(f"  <dcvalue {attributes}>"), xml_escape(v), F.lit("</dcvalue>"))


def manifest(files: Column, separator: str = "||") -> Column:
    """Base names of an item's files, in ASCII, a line each."""
    names = F.filter(F.transform(F.split(F.coalesce(files, F.lit("")), "\\Q" + separator + "\\E"), lambda p: ascii_letters(F.substring_index(F.trim(p), "/", -1))), lambda n: n != "")
    return F.array_join(names, "\n")


def package_files(df: DataFrame, number: str) -> DataFrame:
    """(path, content) of every text file of the packages of rows: folder item_NNN by number, a document per schema, contents."""
    folder = F.format_string("item_%03d/", F.col(number))
    parts = [F.struct(F.concat(folder, F.lit("dublin_core.xml" if s == "dc" else f"metadata_{s}.xml")).alias("path"), item_xml(df.columns, s).alias("content")) for s in schemas(df.columns)]
    if "files" in df.columns:
        parts.append(F.struct(F.concat(folder, F.lit("contents")).alias("path"), manifest(col("files")).alias("content")))
    return df.select(F.explode(F.array(*parts)).alias("x")).select("x.path", "x.content")


def write_packages(files: DataFrame, spark_path: str) -> None:
    """Each task writes its files through Hadoop's file systems, so any store that Spark reads will do."""
    files.repartition(F.substring_index("path", "/", 1)).select("path", F.col("content").cast("binary").alias("content")).write.mode("overwrite").parquet(spark_path)


def write_directories(files: DataFrame, uri: str) -> DataFrame:
    """(item, files): writes every file of packages under its own path in a folder that all executors reach (an address of any
    store that pyarrow knows, or a shared path). A rerun task writes the same files again, each whole or not at all."""
    from collections.abc import Iterator

    import pandas as pd

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                folder, _, name = f"{root}/{path}".rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{folder}/{name}")
            yield pd.DataFrame({"item": frame["path"].str.split("/").str[0]})

    done = files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(step, "item string")
    return done.groupBy("item").agg(F.count("*").alias("files"))


def write_archive(files: DataFrame, path: str) -> int:
    """One deflated archive of all packages, with relative names, in order; its number of files. The importer takes a single file,
    so the driver writes it, holding one partition's files at a time."""
    number = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.select("path", F.col("content").cast("binary").alias("content")).orderBy("path").toLocalIterator():
            z.writestr(zipfile.ZipInfo(row.path), bytes(row.content), zipfile.ZIP_DEFLATED)
            number += 1
    return number


def zipped(files: DataFrame) -> DataFrame:
    """One deflated archive per item folder, as (path, content): built per folder, never for a whole export at once."""
    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(frame["path"], frame["content"])):
                z.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [frame["path"].iloc[0].split("/")[0] + ".zip"], "content": [buffer.getvalue()]})

    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).applyInPandas(pack, "path string, content binary")


def validate_packages(files: DataFrame) -> DataFrame:
    """A report before import: for each folder, its files, and whether it has a main document and no empty file."""
    folder = F.substring_index("path", "/", 1)
    return files.groupBy(folder.alias("item")).agg(F.count("*").alias("files"), F.max(F.col("path").endswith("/dublin_core.xml").cast("int")).alias("has_main"), F.count_if(F.length("content") == 0).alias("empty")).withColumn("valid", (F.col("has_main") == 1) & (F.col("empty") == 0))
