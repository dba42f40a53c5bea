"""Packing documents into fixed windows by best-fit decreasing.

A document's ids (with an end id) are cut into full windows as long as they last; what remains of each document is packed,
longest first, into the open window that it fills most tightly. A segment tree over remaining capacities finds that window in
log2(window) steps. Packing runs within each input partition, in lots of LOT pieces: windows are independent of one another,
so nothing is shuffled or gathered, and a lost task is packed again alike. The windows that a lot leaves open at its end are
filled by cutting: the pieces of its emptiest windows are cut to fit the gaps of the others.

Null or empty text: the end id alone, a piece of one token. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import _lots, _ragged
from .sparkio import keyed, mapped
from .textkernel import Slab, lowered

#: Pieces that one lot packs together.
LOT = 1 << 17
#: Parts of words that a worker remembers (about 30 bytes each) before it starts afresh.
MEMO = 3_000_000
#: Separators for Python that are no white space for the tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Kinds of code points: a word of Latin letters and then signs is two parts that are encoded apart; any other word is one.
_SPACE, _LETTER, _SIGN, _OTHER = range(4)
_built: dict[bytes, "WordEncoder"] = {}
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    if not _kinds:
        kind = np.full(0x10001, _OTHER, np.uint8)
        for i in range(0x3001):
            if chr(i).isspace():
                kind[i] = _SPACE
        for low, high in ("AZ", "az", "ÀÖ", "Øö", "øÿ"):
            kind[ord(low) : ord(high) + 1] = _LETTER
        for low, high in ("!&", "(/", ":@", "[`", "{~"):
            kind[ord(low) : ord(high) + 1] = _SIGN
        _kinds.append(kind)
    return _kinds[0]


class PartTable:
    """Hashes of parts to their numbers, from 0 in the order of coming: open addressing with linear probing, by whole arrays."""

    def __init__(self) -> None:
        self.bits, self.size = 16, 0
        self.keys, self.numbers = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers, -1 where there is none."""
        slot = self._slot(hashes)
        out = self.numbers[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(left):
            slot[left] = (slot[left] + 1) & (1 << self.bits) - 1
            out[left] = self.numbers[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[slot[left]] != hashes[left])]
        return out

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot, left = self._slot(hashes), np.arange(len(hashes))
        while len(left):
            free = left[self.numbers[slot[left]] < 0]
            self.numbers[slot[free]] = numbers[free]  # of several for one slot the last stays
            won = self.numbers[slot[free]] == numbers[free]
            self.keys[slot[free[won]]] = hashes[free[won]]
            left = left[self.numbers[slot[left]] != numbers[left]]
            slot[left] = (slot[left] + 1) & (1 << self.bits) - 1

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        while 3 * (self.size + len(hashes)) > 1 << self.bits:
            full = self.numbers >= 0
            keys, numbers = self.keys[full], self.numbers[full]
            self.bits += 1
            self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(keys, numbers)
        self._place(hashes, np.arange(self.size, self.size + len(hashes), dtype=np.int32))
        self.size += len(hashes)


class WordEncoder:
    """A tokenizers file whose pieces never cross white space, with a table of the ids of words (or their two parts) met before."""

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        self.special = tuple(str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.final[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.table = PartTable()
        self.flat, self.ends, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and the number of each, of words that are one piece each: encoded in lots as one text, and parted after
        the tokens that end a word."""
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 2000):
            lot = words[k : k + 2000]
            ids = np.array(self._ids([" ".join(lot)])[0], np.int64)
            cut = np.flatnonzero(self.final[ids]) + 1
            if len(cut) != len(lot):
                each = self._ids(lot)
                ids, cut = np.fromiter(chain.from_iterable(each), np.int64), np.cumsum([len(e) for e in each])
            flat.append(ids)
            sizes.append(np.diff(cut, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, begin, more = self.table.size, self.size, len(sizes)
        while len(self.ends) < n + more:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.flat) < begin + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.table.add(hashes)
        self.ends[n : n + more] = begin + np.cumsum(sizes)
        self.size = begin + len(flat)
        self.flat[begin : self.size] = flat

    def _numbers(self, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, plain: bool) -> np.ndarray:
        """The numbers of segments of the text, after learning the ids of new ones; plain: each is one piece."""
        found = self.table.find(hashes)
        if len(miss := np.flatnonzero(found < 0)):
            new, first = np.unique(hashes[miss], return_index=True)
            at = miss[first]
            words = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            if plain:
                flat, sizes = self._ids_of_words(words)
            else:
                each = self._ids(words)
                flat, sizes = np.fromiter(chain.from_iterable(each), np.int64), np.array([len(e) for e in each])
            self._learn(new, flat, sizes)
            found[miss] = self.table.find(hashes[miss])
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.table.size > MEMO:
            self._forget()
        whole = [i for i, t in enumerate(texts) if any(c in t for c in _ODD) or "<|" in t and any(s in t for s in self.special)]
        slab = Slab(["" if i in set(whole) else t for i, t in enumerate(texts)] if whole else texts)
        text = "".join(slab.texts)
        kind = _kind_table()[np.minimum(slab.codes, 0x10000)]
        starts, ends, owner = slab.runs(kind != _SPACE)
        letters = np.concatenate([[0], np.cumsum(kind == _LETTER)])
        signs = np.concatenate([[0], np.cumsum(kind == _SIGN)])
        middle = starts + letters[ends] - letters[starts]
        two = (middle + signs[ends] - signs[starts] == ends) & (letters[middle] - letters[starts] == middle - starts)
        low = lowered(slab.codes)
        # Two places a word: its letters and its signs, or the word as it stands and nothing.
        number = np.full(2 * len(starts), -1, np.int64)
        at = np.flatnonzero(two & (middle > starts))
        number[2 * at] = self._numbers(text, starts[at], middle[at], slab.hash(starts[at], middle[at], low), True)
        at = np.flatnonzero(two & (middle < ends))
        number[2 * at + 1] = self._numbers(text, middle[at], ends[at], slab.hash(middle[at], ends[at]), True)
        at = np.flatnonzero(~two)
        number[2 * at] = self._numbers(text, starts[at], ends[at], slab.hash(starts[at], ends[at]) ^ np.uint64(1), False)
        stop = np.where(number >= 0, self.ends[number], 0)
        begin = np.where(number > 0, self.ends[number - 1], 0)
        ids = self.flat[_ragged(begin, stop - begin)].astype("<u4")
        upto = np.concatenate([[0], np.cumsum(stop - begin)])[2 * np.searchsorted(owner, np.arange(len(texts) + 1))]
        out = [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        for i in whole:
            out[i] = np.array(self._ids([texts[i]])[0], "<u4")
        return out


class CapacityTree:
    """A segment tree over capacities 0 to top that tells the least capacity, from a given one on, that an open window has."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(top + 1)]

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.open[i] += 1
            i >>= 1

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """The window of least capacity that holds need, and its capacity."""
        i = need + self.leaves
        if not self.open[i]:
            while i > 1 and not (not i & 1 and self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.open[i] -= 1
            i >>= 1
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """For pieces of 1 to window tokens: the window of each, its offset there, and the number of windows."""
    tree, count = CapacityTree(window), 0
    at, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if (found := tree.pop_tightest(need)) is None:
            found = (count, window)
            count += 1
        at[i], offset[i] = found[0], window - found[1]
        if found[1] > need:
            tree.push(found[1] - need, found[0])
    return at, offset, count


def fill_gaps(pieces: list[list], at: list[int], count: int, window: int) -> list[tuple[int, list]]:
    """Pieces [doc_id, start, ids, doc_tokens] by window, with gaps filled: the pieces of the emptiest windows are cut to fit."""
    rooms: list[list[list]] = [[] for _ in range(count)]
    used = [0] * count
    for piece, w in zip(pieces, at):
        rooms[w].append(piece)
        used[w] += len(piece[2])
    order = sorted((w for w in range(count) if used[w] < window), key=lambda w: (used[w], w))
    low, high = 0, len(order) - 1
    while low < high:
        donor, taker = order[low], order[high]
        if not rooms[donor]:
            low += 1
            continue
        gap = window - used[taker]
        if not gap:
            high -= 1
            continue
        piece = rooms[donor][-1]
        if len(piece[2]) <= gap:
            rooms[donor].pop()
            moved = piece
        else:
            cut = len(piece[2]) - gap
            moved = [piece[0], piece[1] + cut, piece[2][cut:], piece[3]]
            piece[2] = piece[2][:cut]
        rooms[taker].append(moved)
        used[taker] += len(moved[2])
        used[donor] -= len(moved[2])
    return [(w, room) for w, room in enumerate(rooms) if room]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """The tokenizer file is read on the driver and broadcast (1.7 MB, a fixed file). end_id follows each document."""

    def __init__(self, spark: SparkSession, tokenizer_path: str, window: int = 2048, end_id: int = 1):
        with open(tokenizer_path, "rb") as f:
            self._file = spark.sparkContext.broadcast(f.read())
        self.window, self.end_id = window, end_id

    def pack(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
        """A row per piece; with_ids adds the ids themselves (array of int)."""
        file, window, end_id = self._file, self.window, self.end_id

        def rows(pieces: list[list], first: int) -> tuple[list[tuple], int]:
            """The rows of a lot whose windows are numbered from first on, and the next free number."""
            full = [p for p in pieces if len(p[2]) == window]
            rest = sorted((p for p in pieces if len(p[2]) < window), key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
            at, _, count = best_fit_decreasing([len(p[2]) for p in rest], window)
            out = [(p, first + i, 0) for i, p in enumerate(full)]
            first += len(full)
            for w, room in fill_gaps(rest, at, count, window):
                offset = 0
                for p in room:
                    out.append((p, first + w, offset))
                    offset += len(p[2])
            return out, first + count

        def batch_of(lot: list[tuple], part: int) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(lot), 10_000):
                some = lot[k : k + 10_000]
                columns = {
                    "doc_id": pa.array([p[0] for p, _, _ in some], pa.int64()),
                    "start": pa.array([p[1] for p, _, _ in some], pa.int64()),
                    "length": pa.array([len(p[2]) for p, _, _ in some], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p[2].tobytes()) for p, _, _ in some], pa.int64()),
                    "doc_tokens": pa.array([p[3] for p, _, _ in some], pa.int64()),
                    "sequence_id": pa.array([(part << 33) + w for _, w, _ in some], pa.int64()),
                    "offset": pa.array([o for _, _, o in some], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([p[2].astype(np.int32) for p, _, _ in some], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if file.value not in _built:
                _built[file.value] = WordEncoder(file.value)
            encoder, part, pieces, number, held = _built[file.value], TaskContext.get().partitionId(), [], 0, 0
            end = np.array([end_id], "<u4")
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, texts in _lots([t or "" for t in batch.column(1).to_pylist()]):
                    for doc_id, tokens in zip(ids[first:], encoder.encode(texts)):
                        tokens = np.concatenate([tokens, end])
                        pieces += [[doc_id, k, tokens[k : k + window], len(tokens)] for k in range(0, len(tokens), window)]
                        held += len(tokens)
                    if len(pieces) >= LOT or held >= LOT * 256:
                        lot, number = rows(pieces, number)
                        yield from batch_of(lot, part)
                        pieces, held = [], 0
            lot, number = rows(pieces, number)
            yield from batch_of(lot, part)

        return mapped(keyed(df, id_col, text_col), step, SCHEMA + ", ids array<int>" * with_ids)
