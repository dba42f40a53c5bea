"""Token ids as binary shards in the order of document ids, with a minimal perfect hash index from a document's id to its ids.

Writing: documents are encoded where they are read; bounds between shards are quantiles of a bounded sample of (id, row),
weighted by length, so shards are of like size even if one id holds many rows; one shuffle takes ids to their shard, sorted, and
each shard is written by one task. A shard is the raw ids of its documents end to end (two bytes each if the vocabulary allows,
else four), then the documents' keys and where they start, then a trailer:

    ids | keys: int64 x documents | starts: int64 x (documents + 1) | bytes an id, null keys, documents, tokens: int64 x 4 | magic

The index: keys go to index files by a hash; a file's keys get a minimal perfect hash (levels of bit arrays: a key stands in the
first level where it meets no other, and its slot is the number of bits before its own), and the slot holds the key's
fingerprint, shard, number of its first document there, that one's offset and length, and how many documents have the key. So
an access reads a few words of the index and then the ids themselves, whatever the number of documents; a key that was never
written is told by its fingerprint (32 bits) and, for certain, by the key in the shard. A table of the files (a row each) is
written last and makes the folder valid: files of tasks that failed or ran twice are not named in it.

Null text: the end id alone. Documents of one key stand next to each other, in no other order, and are found together, over as
many shards as they fill. Documents with a null key come first and are found by a null key. An empty table gives a folder
without shards, and every lookup gives no rows. Texts of any length are one document. Only the named columns are read, so other
names may clash. The folder must be one that pyarrow can write to from every executor.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import _lots, _ragged
from .packing import WordEncoder
from .sparkio import keyed, mapped, quoted
from .textkernel import U64, mix64

MAGIC = b"TOKSHRD1"
#: Bytes of text that a shard holds, about; keys of an index file.
SHARD, KEYS = 256 << 20, 1 << 20
#: Rows that bounds between shards are taken from, about.
SAMPLE = 20_000
#: Bits of a level for each key that it is offered; levels before what is left is listed.
ROOM, LEVELS = 2, 40
#: Bytes of ids that a reader holds.
READ = 16 << 20
_built: dict[bytes, WordEncoder] = {}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class PerfectHash:
    """Distinct int64 keys to the numbers 0 to n - 1."""

    def __init__(self, keys: int, sizes: np.ndarray, words: np.ndarray, extra: np.ndarray):
        self.keys, self.sizes, self.words, self.extra = keys, sizes, words, extra
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones

    @staticmethod
    def place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix64(keys.view(U64) + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, words = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            bits = -(-ROOM * len(left) // 64) * 64
            at = cls.place(left, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = left[~alone[at]]
        return cls(len(keys), np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, U64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; any slot, or -1, for one that is not among those it was built from."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(left):
                return out
            at = self.first[level] + self.place(keys[left], level, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            here = (word >> bit & U64(1)) > 0
            below = np.bitwise_count(word[here] & ((U64(1) << bit[here]) - U64(1)))
            out[left[here]] = self.rank[at[here] >> 6] + below
            left = left[~here]
        if len(left) and len(self.extra):
            at = np.minimum(np.searchsorted(self.extra, keys[left]), len(self.extra) - 1)
            here = self.extra[at] == keys[left]
            out[left[here]] = self.keys - len(self.extra) + at[here]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(U64) ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


#: What a slot holds.
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("number", "<i8"), ("offset", "<i8"), ("tokens", "<i8"), ("copies", "<i8")])


class IndexFile:
    """A perfect hash and its slots, as bytes and back."""

    def __init__(self, hashed: PerfectHash, slots: np.ndarray):
        self.hashed, self.slots = hashed, slots

    @classmethod
    def build(cls, keys: np.ndarray, entries: np.ndarray) -> "IndexFile":
        """entries: a SLOT for each of the distinct keys, but for fingerprints."""
        hashed = PerfectHash.build(keys)
        slots = np.zeros(len(keys), SLOT)
        slots[hashed.slots(keys)] = entries
        slots["fingerprint"][hashed.slots(keys)] = fingerprints(keys)
        return cls(hashed, slots)

    def to_bytes(self) -> bytes:
        h = self.hashed
        head = np.array([h.keys, len(h.sizes), len(h.words), len(h.extra), *h.sizes], "<i8")
        return MAGIC + head.tobytes() + h.words.astype("<u8").tobytes() + h.extra.astype("<i8").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "IndexFile":
        keys, levels, words, extra = np.frombuffer(raw, "<i8", 4, 8).tolist()
        at = 8 + 32
        parts = []
        for kind, n in (("<i8", levels), ("<u8", words), ("<i8", extra), (SLOT, keys)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(PerfectHash(keys, *parts[:3]), parts[3])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys have a slot with their fingerprint, and those slots."""
        at = self.hashed.slots(keys)
        good = at >= 0
        good[good] = self.slots["fingerprint"][at[good]] == fingerprints(keys[good])
        return good, self.slots[at[good]]


class Shard:
    """A shard's documents, read by ranges."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.file = where.open_input_file(path)
        end = self.file.size()
        self.width, self.nulls, self.documents, self.tokens, magic = *np.frombuffer(self.file.read_at(32, end - 40), "<i8").tolist(), self.file.read_at(8, end - 8)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.table = self.tokens * self.width

    def keys(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * self.documents, self.table), "<i8")

    def starts(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * (self.documents + 1), self.table + 8 * self.documents), "<i8")

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, begin * self.width), f"<u{self.width}").astype("<u4")


class ShardWriter:
    """Writes one shard as its documents come."""

    def __init__(self, folder: str, number: int, width: int):
        where, path = _open(folder)
        context = TaskContext.get()
        self.name = f"shard-{number:07d}-{context.taskAttemptId() if context else 0}.tok"
        self.out, self.width, self.keys, self.sizes, self.nulls = where.open_output_stream(f"{path}/{self.name}"), width, [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.nulls += key is None
        self.keys.append(key or 0)
        self.sizes.append(len(ids) // self.width)

    def close(self) -> tuple[str, int, int, int]:
        starts = np.concatenate([[0], np.cumsum(np.array(self.sizes, np.int64))])
        self.out.write(np.array(self.keys, "<i8").tobytes() + starts.astype("<i8").tobytes())
        self.out.write(np.array([self.width, self.nulls, len(self.keys), starts[-1]], "<i8").tobytes() + MAGIC)
        self.out.close()
        return self.name, len(self.keys), int(starts[-1]), self.nulls


@dataclass
class Bounds:
    """Where shards begin but the first: of null keys by row alone, of others by key and row."""

    null_rows: np.ndarray
    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, sample: list[tuple[int | None, int, int]], shards: int) -> "Bounds":
        """sample: key, row and weight."""
        ordered = sorted(sample, key=lambda s: (s[0] is not None, s[0] or 0, s[1]))
        weight = np.cumsum([s[2] for s in ordered]) if ordered else np.zeros(0)
        cut = np.unique(np.searchsorted(weight, np.arange(1, shards) * (weight[-1] / shards))) if ordered else []
        chosen = [ordered[i] for i in cut if i]
        full = [s for s in chosen if s[0] is not None]
        return cls(np.array([s[1] for s in chosen if s[0] is None], np.int64), np.array([s[0] for s in full], np.int64), np.array([s[1] for s in full], np.int64))

    def shard(self, keys: list[int | None], rows: np.ndarray) -> np.ndarray:
        null = np.array([k is None for k in keys], bool)
        known = np.array([k or 0 for k in keys], np.int64)
        low, high = np.searchsorted(self.keys, known, "left"), np.searchsorted(self.keys, known, "right")
        out = low.copy()
        for i in np.flatnonzero((low < high) & ~null):
            out[i] += np.searchsorted(self.rows[low[i] : high[i]], rows[i], "right")
        out += len(self.null_rows)
        out[null] = np.searchsorted(self.null_rows, rows[null], "right")
        return out


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and row: a number for each row that scatters rows of one key, and is the same whenever a split is read."""
    return keyed(df, id_col, text_col).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))


def write(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encodes the texts and writes shards, index and the table of files below the folder."""
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    rows, least = _rows(df, id_col, text_col), int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    chosen = rows.where(F.xxhash64("row") <= int((share - 0.5) * 1.9999 * 2**63)).select("doc_id", "row", weight.alias("weight"))
    sample = [tuple(r) for r in chosen.limit(4 * SAMPLE).collect()]
    shards = max(least, -(-int(sum(s[2] for s in sample) / share) // SHARD))
    bounds = spark.sparkContext.broadcast(Bounds.of(sample, shards))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file.value not in _built:
            _built[file.value] = WordEncoder(file.value)
        encoder = _built[file.value]
        kind = "<u2" if len(encoder.final) <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            keys, numbers = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for first, texts in _lots([t or "" for t in batch.column(1).to_pylist()]):
                part = slice(first, first + len(texts))
                ids = [tokens.astype(kind).tobytes() + end for tokens in encoder.encode(texts)]
                columns = [pa.array(bounds.value.shard(keys[part], numbers[part]), pa.int32()), pa.array(keys[part], pa.int64()), pa.array(numbers[part]), pa.array([len(end)] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "key", "row", "width", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, done = None, None, []
        for batch in batches:
            for shard, key, width, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if shard != now:
                    if writer:
                        done.append((now, *writer.close()))
                    now, writer = shard, ShardWriter(folder, shard, width)
                writer.add(key, ids)
        if writer:
            done.append((now, *writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)] if done else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())], names=["shard", "file", "documents", "tokens", "nulls"])

    encoded = mapped(rows, encode, "shard int, key long, row long, width int, ids binary")
    dealt = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "row")
    files = mapped(dealt, store, "shard long, file string, documents long, tokens long, nulls long")
    found = sorted(tuple(r) for r in files.collect())  # a row each file
    _commit(folder, "shards", [{"file": f, "documents": d, "tokens": t, "nulls": n} for _, f, d, t, n in found])
    _write_index(spark, folder, least)


def _commit(folder: str, kind: str, rows: list[dict]) -> None:
    """Writes the table of files, and removes files of this kind that it does not name."""
    where, path = _open(folder)
    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("documents", "tokens", "nulls"))])
    raw = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows, schema), raw)
    named = {r["file"] for r in rows}
    for info in where.get_file_info(fs.FileSelector(path)):
        if info.base_name.startswith(f"{kind[:5]}-") and info.base_name not in named:
            where.delete_file(info.path)
    with where.open_output_stream(f"{path}/{kind}.parquet") as out:
        out.write(raw.getvalue())


class Files:
    """What a folder holds: its shards in order, how many documents and tokens stand before each, and its index files."""

    def __init__(self, folder: str):
        self.folder = folder
        self.where, self.path = _open(folder)
        tables = {kind: pq.read_table(self.where.open_input_file(f"{self.path}/{kind}.parquet")) for kind in ("shards", "index")}
        self.shards, self.index = (tables[k]["file"].to_pylist() for k in ("shards", "index"))
        self.documents, self.tokens = (np.concatenate([[0], np.cumsum(tables["shards"][c].to_numpy())]).astype(np.int64) for c in ("documents", "tokens"))
        self.nulls = int(sum(tables["shards"]["nulls"].to_pylist()))

    def shard(self, number: int) -> Shard:
        return Shard(self.where, f"{self.path}/{self.shards[number]}")

    def index_file(self, number: int) -> IndexFile | None:
        if not self.index[number]:
            return None
        with self.where.open_input_file(f"{self.path}/{self.index[number]}") as f:
            return IndexFile.from_bytes(f.read())

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key: a look into one index file, then reads of ids alone."""
        route = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=42)  # as Spark's xxhash64 of a long
        route -= (route >> 63) << 64
        found = self.index_file(route % len(self.index)) if self.index else None
        good, slots = found.find(np.array([key], np.int64)) if found else (np.zeros(1, bool), ())
        if not good[0]:
            return []
        out, number, left = [], int(slots[0]["shard"]), int(slots[0]["copies"])
        at = int(slots[0]["number"])
        while left > 0:
            shard = self.shard(number)
            starts, keys = shard.starts(), shard.keys()
            for i in range(at, min(at + left, shard.documents)):
                if keys[i] != key:
                    return out
                out.append(shard.ids(int(starts[i]), int(starts[i + 1])))
            left -= shard.documents - at
            number, at = number + 1, 0
        return out


def _write_index(spark: SparkSession, folder: str, least: int) -> None:
    tables = _open(folder)
    shards = pq.read_table(tables[0].open_input_file(f"{tables[1]}/shards.parquet"))
    names = spark.sparkContext.broadcast(shards["file"].to_pylist())
    count = shards.num_rows
    files = max(least, -(-int(sum(shards["documents"].to_pylist())) // KEYS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard = Shard(where, f"{path}/{names.value[number]}")
                found, starts = shard.keys()[shard.nulls :], shard.starts()[shard.nulls :]
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                columns = [found[first], np.full(len(first), number), first + shard.nulls, starts[first], np.diff(starts)[first], np.diff(np.append(first, len(found)))]
                for k in range(0, len(first), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000], pa.int64()) for c in columns], names=["key", *SLOT.names[1:]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        out, now, held = [], None, []

        def close() -> None:
            columns = [np.concatenate(c) for c in zip(*held)]
            first = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            entries = np.zeros(len(first), SLOT)
            for name, column in zip(SLOT.names[1:], columns[1:]):
                entries[name] = column[first]
            entries["copies"] = np.add.reduceat(columns[-1], first)
            name = f"index-{now:07d}-{TaskContext.get().taskAttemptId()}.mph"
            with where.open_output_stream(f"{path}/{name}") as f:
                f.write(IndexFile.build(columns[0][first], entries).to_bytes())
            out.append((now, name, len(first)))

        for batch in batches:
            routes, columns = batch.column(0).to_numpy(), [c.to_numpy() for c in batch.columns[1:]]
            cut = [0, *(np.flatnonzero(routes[1:] != routes[:-1]) + 1).tolist(), len(routes)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a < b and routes[a] != now:
                    if held:
                        close()
                    now, held = int(routes[a]), []
                if a < b:
                    held.append([c[a:b] for c in columns])
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["route", "file", "keys"])

    entries = mapped(spark.range(0, count, 1, max(1, min(count, least))), keys, "key long, shard long, number long, offset long, tokens long, copies long")
    routed = entries.select(_route(files), "key", *SLOT.names[1:]).repartitionById(files, F.col("route")).sortWithinPartitions("route", "key", "shard")
    found = {r.route: (r.file, r["keys"]) for r in mapped(routed, build, "route long, file string, keys long").collect()}  # a row each file
    _commit(folder, "index", [{"file": found.get(i, ("", 0))[0], "documents": found.get(i, ("", 0))[1], "tokens": 0, "nulls": 0} for i in range(files)])


def _route(files: int):
    return F.pmod(F.xxhash64("key"), F.lit(files)).cast("int").alias("route")


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """For each distinct key every document that has it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian 32-bit integers) and, if asked for, ids. Keys go to their index file, what it says to the
    shards; only keys and places are shuffled."""
    files = Files(folder)
    known = spark.sparkContext.broadcast((files.shards, files.index, files.documents, files.tokens, files.nulls))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not files.shards:
        return spark.createDataFrame([], schema)

    def opened() -> Files:
        out = Files.__new__(Files)
        out.folder = folder
        out.where, out.path = _open(folder)
        out.shards, out.index, out.documents, out.tokens, out.nulls = known.value
        return out

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, index = opened(), None, None
        for batch in batches:
            routes, null = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            asked = batch.column(1).fill_null(0).to_numpy()
            for route in np.unique(routes).tolist():
                if route != now:
                    now, index = route, files.index_file(route)
                mine = asked[(routes == route) & ~null]
                if index is not None and len(mine):
                    good, slots = index.find(mine)
                    begin = files.documents[slots["shard"]] + slots["number"]
                    yield from _pieces(files, mine[good], begin, slots["copies"].astype(np.int64), False)
            if null.any() and files.nulls:
                yield from _pieces(files, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([files.nulls], np.int64), True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, shard = opened(), None, None
        for batch in batches:
            numbers, asked, first, count = (batch.column(i).fill_null(0).to_numpy() for i in range(4))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                if numbers[a] != now:
                    now, shard = int(numbers[a]), files.shard(int(numbers[a]))
                    keys, starts = shard.keys(), shard.starts()
                number = _ragged(first[a:b], count[a:b])
                key = np.repeat(asked[a:b], count[a:b])
                absent = np.repeat(null[a:b], count[a:b])
                good = np.where(absent, number < shard.nulls, (number >= shard.nulls) & (keys[number] == key))
                yield from _documents(shard, starts, int(files.tokens[now]), number[good], key[good], absent[good], with_ids)

    wanted = keys.select(F.col(quoted(key_col)).cast("long").alias("key")).distinct()
    routed = wanted.select(_route(len(files.index)), "key").repartitionById(len(files.index), F.col("route"))
    placed = mapped(routed, places, "shard int, key long, first long, count long")
    dealt = placed.repartitionById(len(files.shards), F.col("shard")).sortWithinPartitions("shard", "first")
    return mapped(dealt, read, schema)


def _pieces(files: Files, keys: np.ndarray, begin: np.ndarray, copies: np.ndarray, null: bool) -> Iterator[pa.RecordBatch]:
    """Runs of documents cut at the ends of shards."""
    low = np.searchsorted(files.documents, begin, "right") - 1
    high = np.searchsorted(files.documents, begin + copies, "left")
    spans = high - low
    for k in range(0, len(keys), 10_000):
        part = slice(k, k + 10_000)
        shard = _ragged(low[part], spans[part])
        a = np.maximum(np.repeat(begin[part], spans[part]), files.documents[shard])
        b = np.minimum(np.repeat(begin[part] + copies[part], spans[part]), files.documents[shard + 1])
        key = pa.nulls(len(shard), pa.int64()) if null else pa.array(np.repeat(keys[part], spans[part]))
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), key, pa.array(a - files.documents[shard]), pa.array(b - a)], names=["shard", "key", "first", "count"])


def _documents(shard: Shard, starts: np.ndarray, base: int, number: np.ndarray, key: np.ndarray, absent: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of documents in ascending order: neighbours are read together, up to READ bytes."""
    at = 0
    while at < len(number):
        begin = int(starts[number[at]])
        run = np.searchsorted(np.cumsum(np.diff(number[at : at + 10_000]) != 1), 0, "right") + 1
        most = np.searchsorted(starts[number[at : at + run] + 1], begin + READ // shard.width, "right")
        run = max(1, min(int(run), int(most)))
        some = number[at : at + run]
        ids = shard.ids(begin, int(starts[some[-1] + 1]))
        a, b = starts[some] - begin, starts[some + 1] - begin
        each = [ids[i:j] for i, j in zip(a.tolist(), b.tolist())]
        columns = [pa.array(key[at : at + run], pa.int64(), mask=absent[at : at + run]), pa.array(base + starts[some]), pa.array(b - a), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        at += run


def digests(df: DataFrame, shared: str, tokenizer_path: str) -> tuple[DataFrame, str]:
    """Writes df's documents below a shared folder and looks every key of df up again; and the folder that holds the files."""
    folder = f"{shared}/catalogsmith/tokens-{uuid.uuid4().hex}"
    write(df, folder, tokenizer_path)
    return lookup(df.sparkSession, folder, df), folder
