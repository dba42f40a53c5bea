"""Byte-level BPE encoding and decoding over numpy matrices.

Pieces of text (matches of the split pattern) are encoded together: pieces of alike length form one padded matrix of token
ids, and in each round every row merges its leftmost pair of least rank, found by a vectorised lookup in an open-addressing
table of pairs; rows are then compacted, and rows without a pair leave. A piece seen before comes from a bounded memo.
A piece longer than WIDE bytes is merged through a heap instead, in O(n log n): the same merges in the same order.

Null text counts as empty and gives no ids. Repeated rows each give their row. Any text round-trips byte by byte.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .sparkio import keyed, mapped

#: Rows up to this many bytes are merged as matrices.
WIDE = 256
#: Pieces that the memo of a worker holds before it starts afresh.
MEMO = 600_000
_NONE = np.int64(1 << 40)
_built: dict[str, "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """(left id, right id) to the rank of the merged token: open addressing with linear probing, looked up by whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        left = np.arange(len(keys))
        all_keys, all_values = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(all_keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = all_keys[left[free]]  # of several for one slot the last stays
            won = self.keys[slot[left]] == all_keys[left]
            self.values[slot[left[won]]] = all_values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; _NONE where the pair (or either side, given as negative) has none."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        shape = keys.shape
        keys = keys.ravel()
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            have = self.keys[slot[open_]]
            hit = have == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (have != -1)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.size = max(ranks.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.token_at = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(t) for t in by_rank], out=self.token_at[1:])
        self.whole = ranks
        self.decimals = [b"%d" % i for i in range(self.size)]
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)

    def _merge_wide(self, ids: list[int]) -> list[int]:
        """Merges by a heap of (rank, position), with stale entries skipped."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pair = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(pair) if r < _NONE]
        heapq.heapify(heap)
        table = {}

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in table:
                table[a, b] = int(self.pairs.find(np.array([a]), np.array([b]))[0])
            return table[a, b]

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of(rank, ids[after[j]])) < _NONE:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if before[i] >= 0 and (r := rank_of(ids[before[i]], rank)) < _NONE:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x, there in zip(ids, alive) if there]

    def _merge(self, matrix: np.ndarray) -> np.ndarray:
        """Merges all rows of ids, padded with -1 on the right, to the end; the same padding in the result."""
        out = np.full_like(matrix, -1)
        rows = np.arange(len(matrix))
        ranks = self.pairs.find(matrix[:, :-1], matrix[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            k = np.arange(len(rows))
            least = ranks[k, at]
            done = least >= _NONE
            if done.any():
                out[rows[done], : matrix.shape[1]] = matrix[done]
                rows, matrix, ranks, at, least = rows[~done], matrix[~done], ranks[~done], at[~done], least[~done]
                if not len(rows):
                    break
                k = np.arange(len(rows))
            width = matrix.shape[1]
            matrix[k, at] = least
            source = np.arange(width - 1)
            source = source[None, :] + (source[None, :] > at[:, None])
            matrix = np.take_along_axis(matrix, source, 1)
            if width == 2:
                out[rows, :1] = matrix
                break
            ranks = np.take_along_axis(np.hstack([ranks, np.full((len(rows), 1), _NONE)]), source, 1)[:, : width - 2] if width > 2 else ranks
            right = np.minimum(at, width - 3)
            ranks[k, right] = np.where(at <= width - 3, self.pairs.find(matrix[k, right], matrix[k, right + 1]), ranks[k, right])
            left = np.maximum(at - 1, 0)
            ranks[k, left] = np.where(at > 0, self.pairs.find(matrix[k, left], matrix[k, left + 1]), ranks[k, left])
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, a matrix for each bucket of lengths, and puts them into the memo."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        buckets: dict[int, list[int]] = {}
        order, flats, sizes = [], [], []
        for i, r in enumerate(raw):
            if r in self.whole:
                buckets.setdefault(0, []).append(i)
            else:
                buckets.setdefault(-(-len(r) // 4) * 4 if len(r) <= WIDE else WIDE + 1, []).append(i)
        for width, which in buckets.items():
            for lot in (which[i : i + 20_000] for i in range(0, len(which), 20_000)):
                order += lot
                if width == 0:
                    flats.append(np.array([self.whole[raw[i]] for i in lot], np.int32))
                    sizes.append(np.ones(len(lot), np.int64))
                elif width > WIDE:
                    for i in lot:
                        flats.append(np.array(self._merge_wide(self.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist()), np.int32))
                        sizes.append(np.array([len(flats[-1])]))
                else:
                    lengths = np.array([len(raw[i]) for i in lot])
                    ids = self.byte_ids[np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in lot), np.uint8)].reshape(-1, width)
                    ids[np.arange(width)[None, :] >= lengths[:, None]] = -1
                    merged = self._merge(ids)
                    there = merged >= 0
                    sizes.append(there.sum(1))
                    flats.append(merged[there].astype(np.int32))
        n = len(self.memo)
        begin = int(self.ends[n - 1]) if n else 0
        lengths = np.concatenate(sizes)
        while len(self.ends) < n + len(raw):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.flat) < begin + lengths.sum():
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.ends[n : n + len(raw)] = begin + np.cumsum(lengths)
        self.flat[begin : begin + lengths.sum()] = np.concatenate(flats)
        self.memo.update(zip(map(pieces.__getitem__, order), range(n, n + len(pieces))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        split = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self._forget()
        memo = self.memo
        if new := list(set().union(*split).difference(memo)):
            self._learn(new)
        which = np.fromiter(map(memo.__getitem__, chain.from_iterable(split)), np.int64)
        ends = self.ends[which]
        begins = np.where(which > 0, self.ends[which - 1], 0)
        ids = self.flat[_ragged(begins, ends - begins)]
        per_piece = np.concatenate([[0], np.cumsum(ends - begins)])
        bounds = per_piece[np.concatenate([[0], np.cumsum([len(p) for p in split])]).astype(np.int64)]
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        begins = self.token_at[ids]
        sizes = self.token_at[ids + 1] - begins
        data = self.token_bytes[_ragged(begins, sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices begins[i], ..., begins[i] + sizes[i] - 1 of all i, end to end."""
    total = int(sizes.sum())
    shift = begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else begins
    return np.repeat(shift, sizes) + np.arange(total)


def _lots(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


class Tokenizer:
    """Encodes and decodes columns. The ranks (50,256 tokens, a fixed vocabulary file) are read once on the driver and broadcast."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self._file = spark.sparkContext.broadcast(f.read())
        self._pattern = pattern

    def _maker(self):
        file, pattern = self._file, self._pattern

        def codec() -> Codec:
            key = hashlib.sha256(file.value + pattern.encode()).hexdigest()
            if key not in _built:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.value.splitlines())}
                _built[key] = Codec(ranks, pattern)
            return _built[key]

        return codec

    def encode(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and ids (array of int); the text decodes from the ids."""
        make = self._maker()

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = make()
            for batch in batches:
                for first, texts in _lots([t or "" for t in batch.column(1).to_pylist()]):
                    ids, bounds = codec.encode(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

        return mapped(keyed(df, id_col, text_col), step, "doc_id long, ids array<int>")

    def decode(self, df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """doc_id and bytes (binary). A null array decodes to no bytes."""
        make = self._maker()

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = make()
            for batch in batches:
                lists = [x or [] for x in batch.column(1).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                ids = np.array([i for x in lists for i in x], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(ids, bounds), pa.binary())], names=["doc_id", "bytes"])

        return mapped(df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids"), step, "doc_id long, bytes binary")

    def digests(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """encode() and decode() in one pass, so that ids need not leave the worker: their number and the digests of both."""
        make = self._maker()

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = make()
            for batch in batches:
                for first, texts in _lots([t or "" for t in batch.column(1).to_pylist()]):
                    ids, bounds = codec.encode(texts)
                    back = codec.decode(ids, bounds)
                    decimals = list(map(codec.decimals.__getitem__, ids.tolist()))
                    shas = [hashlib.sha256(b",".join(decimals[a:b])).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(texts)), pa.array(np.diff(bounds)), pa.array(shas), pa.array([hashlib.sha256(b).hexdigest() for b in back])],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

        return mapped(keyed(df, id_col, text_col), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
