"""Import packages written by executors: a sink with staging, commit and abort, and one archive made in parallel.

Both need a folder or store that every executor reaches and pyarrow can write to. Nothing of a package passes the driver, which
sees a row for each task alone.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import ascii_letters
from ..schema import col

BLOCK = 8 << 20


def bitstreams(df: DataFrame, number: str, files: str = "files", separator: str = "||") -> DataFrame:
    """path, content (null) and source for every file of the rows: what write_package_tree copies next to an item's documents. Names
    are those that the manifest lists; of files of one name in an item the first stays."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(files), F.lit("")), "\\Q" + separator + "\\E"), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select(F.format_string("item_%03d/", col(number)).alias("item"), F.posexplode(parts).alias("pos", "source"))
    path = F.concat("item", ascii_letters(F.substring_index("source", "/", -1)))
    return rows.groupBy(path.alias("path")).agg(F.min_by("source", "pos").alias("source")).select("path", F.lit(None).cast("binary").alias("content"), "source")


def _copied(store: fs.FileSystem, to: str, content: bytes | None, source: str | None) -> None:
    with store.open_output_stream(to) as out:
        if source is None:
            out.write(content or b"")
            return
        where, path = fs.FileSystem.from_uri(source)
        with where.open_input_stream(path) as f:
            while block := f.read(BLOCK):
                out.write(block)


@dataclass
class _Batch(WriterCommitMessage):
    folder: str
    files: int


class PackageSink(DataSource):
    """``df.write.format("packages").mode("append").save(uri)`` of rows (path, content, source): files under their paths, with the
    content given or copied from a source. Each task writes a batch, a folder of whole items, below a staging folder; the commit
    moves batches to their places and then names them in _batches.json, so a reader sees all of a job or nothing. A failed task is
    tried again in a folder of its own, a failed job leaves no file. In mode overwrite earlier batches go after the commit."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def writer(self, schema, overwrite: bool) -> "PackageWriter":
        return PackageWriter(self.options["path"], overwrite)


class PackageWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex[:12]

    def _root(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.uri)
        return store, root.rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = self._root()
        context = TaskContext.get()
        name, number, made = f"task-{context.partitionId():06d}-{context.taskAttemptId()}", 0, set()
        for row in iterator:
            to = f"{root}/.staging-{self.job}/{name}/{row.path}"
            folder = to.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            _copied(store, to, row.content, row.source)
            number += 1
        return _Batch(name, number)

    def commit(self, messages: list) -> None:
        store, root = self._root()
        store.create_dir(root, recursive=True)
        before = committed(self.uri)
        mine = []
        for i, batch in enumerate(sorted((m for m in messages if m and m.files), key=lambda m: m.folder)):
            store.move(f"{root}/.staging-{self.job}/{batch.folder}", f"{root}/batch-{self.job}-{i:06d}")
            mine.append({"batch": f"batch-{self.job}-{i:06d}", "files": batch.files})
        with store.open_output_stream(f"{root}/._batches-{self.job}") as out:
            out.write(json.dumps(([] if self.overwrite else before) + mine).encode())
        store.move(f"{root}/._batches-{self.job}", f"{root}/_batches.json")
        for old in before if self.overwrite else []:
            store.delete_dir(f"{root}/{old['batch']}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = self._root()
        if store.get_file_info(f"{root}/.staging-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/.staging-{self.job}")


def committed(uri: str) -> list[dict]:
    """The batches of a folder and their numbers of files."""
    store, root = fs.FileSystem.from_uri(uri)
    at = f"{root.rstrip('/')}/_batches.json"
    if store.get_file_info(at).type != fs.FileType.File:
        return []
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


def write_package_tree(files: DataFrame, uri: str, mode: str = "append") -> None:
    """files: path and content, and source if any are to be copied. An item's files go to one task, so to one batch."""
    files.sparkSession.dataSource.register(PackageSink)
    source = F.col("source") if "source" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", F.col("content").cast("binary").alias("content"), source.alias("source"))
    rows.repartition(F.substring_index("path", "/", 1)).write.format("packages").mode(mode).save(uri)


def read_package_tree(spark: SparkSession, uri: str) -> DataFrame:
    """(path, content) of all files of committed batches, empty ones too; a task for each batch."""
    batches = [(b["batch"],) for b in committed(uri)]
    if not batches:
        return spark.createDataFrame([], "path string, content binary")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for frame in frames:
            for batch in frame.column(0).to_pylist():
                top = f"{root.rstrip('/')}/{batch}"
                for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
                    if info.type == fs.FileType.File:
                        with store.open_input_stream(info.path) as f:
                            yield pa.RecordBatch.from_arrays([pa.array([info.path[len(top) + 1 :]]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return spark.createDataFrame(batches, "batch string").repartition(len(batches)).mapInArrow(read, "path string, content binary")


# One archive. Each part of the table is deflated by a task; offsets follow from the sizes of the parts, and tasks write parts and
# their shares of the central directory at their places. Sizes and offsets are given in 64 bits throughout.
_LOCAL, _CENTRAL, _END64, _LOCATOR, _END = 0x04034B50, 0x02014B50, 0x06064B50, 0x07064B50, 0x06054B50
_FULL, _VERSION, _UTF8, _DATE = 0xFFFFFFFF, 45, 1 << 11, (1980 - 1980) << 9 | 1 << 5 | 1


def _local(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<IHHHHHIIIHH", _LOCAL, _VERSION, _UTF8, 8, 0, _DATE, crc, _FULL, _FULL, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, size, packed)


def _central(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    head = struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 3 << 8 | _VERSION, _VERSION, _UTF8, 8, 0, _DATE, crc, _FULL, _FULL, len(name), 28, 0, 0, 0, 0o644 << 16, _FULL)
    return head + name + struct.pack("<HHQQQ", 1, 24, size, packed, offset)


def _ending(entries: int, size: int, offset: int) -> bytes:
    end64 = struct.pack("<IQHHIIQQQQ", _END64, 44, _VERSION, _VERSION, 0, 0, entries, entries, size, offset)
    few = min(entries, 0xFFFF)
    return end64 + struct.pack("<IIQI", _LOCATOR, 0, offset + size, 1) + struct.pack("<IHHHHIIH", _END, 0, 0, few, few, min(size, _FULL), min(offset, _FULL), 0)


def write_archive_parallel(files: DataFrame, uri: str) -> int:
    """One deflated archive of (path, content), in the order of paths; its number of files. Paths are unique. On a shared file system
    (file://) executors write parts at their offsets; in other stores, which have no such writes, the driver appends them in
    blocks of BLOCK bytes. The archive appears under its name when it is whole."""
    store, to = fs.FileSystem.from_uri(uri)
    staging = f"{to}.parts-{uuid.uuid4().hex}"
    store.create_dir(staging, recursive=True)

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        context = TaskContext.get()
        name, at, entries, index = f"part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, 0, 0
        with store.open_output_stream(f"{staging}/{name}") as out, store.open_output_stream(f"{staging}/{name}.entries") as listed:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw, title = content or b"", path.encode()
                    work = zlib.compressobj(6, zlib.DEFLATED, -15)
                    packed = work.compress(raw) + work.flush()
                    crc = zlib.crc32(raw)
                    head = _local(title, crc, len(packed), len(raw))
                    out.write(head)
                    out.write(packed)
                    listed.write(struct.pack("<HIQQQ", len(title), crc, len(packed), len(raw), at) + title)
                    at += len(head) + len(packed)
                    entries += 1
                    index += 46 + len(title) + 28
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "bytes": [at], "entries": [entries], "central": [index]})

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    rows = files.select("path", F.col("content").cast("binary").alias("content")).repartitionByRange("path").sortWithinPartitions("path")
    parts = sorted(tuple(r) for r in rows.mapInArrow(deflate, "part long, name string, bytes long, entries long, central long").collect())  # a row each task
    body = sum(p[2] for p in parts)
    places, at, central = [], 0, body
    for _, name, size, entries, listed in parts:
        places.append((name, at, central))
        at, central = at + size, central + listed

    def directory(name: str, base: int) -> Iterator[bytes]:
        store, _ = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(f"{staging}/{name}.entries") as f:
            while head := f.read(30):
                n, crc, packed, size, offset = struct.unpack("<HIQQQ", head)
                yield _central(f.read(n), crc, packed, size, base + offset)

    def blocks(name: str) -> Iterator[bytes]:
        store, _ = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(f"{staging}/{name}") as f:
            while block := f.read(BLOCK):
                yield block

    whole, ending = f"{staging}/whole", _ending(sum(p[3] for p in parts), central - body, body)
    if isinstance(store, fs.LocalFileSystem):

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, at, central in zip(*(c.to_pylist() for c in batch.columns)):
                    out = os.open(whole, os.O_WRONLY)
                    try:
                        for begin, pieces in ((at, blocks(name)), (central, directory(name, at))):
                            for piece in pieces:
                                os.pwrite(out, piece, begin)
                                begin += len(piece)
                        os.fsync(out)
                    finally:
                        os.close(out)
                yield batch.slice(0, 0)

        with open(whole, "wb") as out:
            out.truncate(central)
        if places:
            spark = files.sparkSession
            todo = spark.createDataFrame(places, "name string, at long, central long").repartition(len(places))
            todo.mapInArrow(place, todo.schema).collect()
        with open(whole, "ab") as out:
            out.write(ending)
    else:
        with store.open_output_stream(whole) as out:
            for name, _, _ in places:
                for block in blocks(name):
                    out.write(block)
            for name, at, _ in places:
                for piece in directory(name, at):
                    out.write(piece)
            out.write(ending)
    store.move(whole, to)
    store.delete_dir(staging)
    return sum(p[3] for p in parts)
