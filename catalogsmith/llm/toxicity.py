"""Toxicity by a support vector machine on a gapped subsequence string kernel, with Nystroem landmarks.

A text is read as words of folded letters: accents and case are dropped, digits that stand for letters are read as such, signs
inside a word are skipped, and letters written one by one are joined. The kernel of two words adds, over all subsequences of
four symbols (word ends count as symbols), the product of their weights; up to one symbol may be skipped between neighbours,
at DECAY each, so an inserted or changed character costs little. It is divided by a function of both lengths.

Training: sentences inherit the label of their document, and a toxic one needs one insult, so this is multiple-instance
learning: each toxic document is stood for by the word that the current machine finds worst, each clean one by its worst word
and by random ones, for a few rounds. Landmarks are words of both kinds; Nystroem features turn the kernel machine into a
linear one, whose weights fold back into one table of subsequence weights (32**4 floats, a fixed size). So a document is scored
by array gathers alone, over all its words. Its score is calibrated on its three worst
words and its length.

At most ``Sample.toxic`` and ``Sample.clean`` labelled documents of at most ``Sample.chars`` code points are learned from,
chosen by a hash of their ids. Null or empty texts get the score of a text without an insult. With labels of one kind only, or
none, every score is the share of toxic labels (0 if none). Repeated rows are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .byte_bpe import _ragged
from .sampling import labelled_texts
from .sparkio import keyed, mapped
from .textkernel import Slab, slabs

DECAY = 0.5
#: Distances between the four symbols of a subsequence: at most one skipped between neighbours, two in all.
STEPS = [(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2) if a + b + c <= 5]
#: Digits read as letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SPACE, SKIP = 254, 255
#: Evidence of a document: its three worst words, and its length.
FEATURES = 4
_tables: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Sample:
    toxic: int = 800
    clean: int = 1200
    chars: int = 20_000
    landmarks: int = 240
    rounds: int = 3


@dataclass
class Model:
    table: np.ndarray  # weights of subsequences
    bias: float
    calibration: np.ndarray  # of the evidence, and a constant
    constant: float | None = None


def _symbols() -> np.ndarray:
    """Of all code points up to the third plane. Styled and accented letters are those that they decompose to; letters of other
    scripts are dealt over all symbols, so that different words of theirs look different."""
    if "symbols" not in _tables:
        kind = np.full(0x40000, SKIP, np.uint8)
        for i in range(0x40000):
            c = chr(i)
            if c in " \t\n\v\f\r\x85\xa0  　":
                kind[i] = SPACE
            elif c in DIGITS:
                kind[i] = ord(DIGITS[c]) - 96
            elif unicodedata.category(c)[0] == "L":
                base = unicodedata.normalize("NFKD", c)[0].lower()
                kind[i] = ord(base) - 96 if "a" <= base <= "z" else 1 + (i * 0x9E3779B1 >> 7) % 31
        _tables["symbols"] = kind
    return _tables["symbols"]


def read_words(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stream of symbols, two zeros before each word and at the end; where words start in it, their lengths and texts."""
    kind = _symbols()[np.minimum(slab.codes, 0x3FFFF)]
    at = np.flatnonzero(kind != SKIP)
    kind = kind[at]
    solid = kind != SPACE
    letters = kind[solid]
    if not len(letters):
        none = np.zeros(0, np.int64)
        return np.zeros(2, np.int64), none, none, none
    gap = np.cumsum(~solid)[solid]
    owner = np.searchsorted(slab.bounds, at[solid], "right") - 1
    new = np.ones(len(letters), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(letters)))
    single = sizes == 1
    joined = np.zeros(len(first), bool)
    joined[1:] = single[1:] & single[:-1] & (owner[first][1:] == owner[first][:-1])
    first = first[~joined]
    sizes = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) + 2 * (np.repeat(np.arange(len(first)), sizes) + 1)
    stream = np.zeros(len(letters) + 2 * len(first) + 4, np.int64)
    stream[place] = letters
    return stream, place[first], sizes, owner[first]


def length_norm(sizes: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(sizes, 14) + 2.0)


def features(stream: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each spacing: the subsequence that begins at each position (the last few left out), and its weight."""
    n = len(stream) - 5
    pair = {d: stream[: len(stream) - d] << 5 | stream[d:] for d in (1, 2)}
    for a, b, c in STEPS:
        yield pair[a][:n] << 10 | pair[c][a + b : a + b + n], DECAY ** (a + b + c - 3)


def word_scores(model_table: np.ndarray, stream: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The kernel part of each word's decision: from its first boundary on, up to the next word's."""
    stream = np.concatenate([stream, np.zeros(5, np.int64)])
    total = np.zeros(len(stream) - 5, np.float32)
    for index, weight in features(stream):
        total += np.float32(weight) * model_table[index]
    return np.add.reduceat(total, first - 2) / length_norm(sizes)


def _inner_zero(index: np.ndarray) -> np.ndarray:
    """Subsequences that no word has: a boundary in the middle, or fewer than two letters."""
    c = [index >> s & 31 for s in (15, 10, 5, 0)]
    return (c[1] == 0) | (c[2] == 0)


class Bag:
    """Words with the sparse features of each."""

    def __init__(self, words: list[bytes]):
        self.words = words
        stream, first = [np.zeros(2, np.int64)], []
        at = 2
        for w in words:
            first.append(at)
            stream += [np.frombuffer(w, np.uint8).astype(np.int64), np.zeros(2, np.int64)]
            at += len(w) + 2
        flat = np.concatenate([*stream, np.zeros(5, np.int64)])
        self.sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), self.sizes + 2)
        rows, index, value = [], [], []
        for found, weight in features(flat):
            found = found[: len(owner)]
            good = ~_inner_zero(found)
            rows.append(owner[good])
            index.append(found[good])
            value.append(np.full(good.sum(), weight))
        self.rows, self.index, self.value = np.concatenate(rows), np.concatenate(index), np.concatenate(value)
        self.value = self.value / length_norm(self.sizes)[self.rows]

    def dense(self, of: np.ndarray) -> np.ndarray:
        """Words x the features numbered in of (ascending)."""
        place = np.minimum(np.searchsorted(of, self.index), len(of) - 1)
        good = of[place] == self.index
        out = np.bincount(self.rows[good] * len(of) + place[good], self.value[good], len(self.words) * len(of))
        return out.reshape(len(self.words), len(of)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = v = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    size = np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 * 2 * c + 1
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - (v * np.append(np.ones(len(v) - 1), 0) - 2 * c * (x.T @ (weight * y * slack))) / size
        v = step + t / (t + 3) * (step - w)
        w = step
    return w[:-1], float(w[-1])


def _documents(texts: list[str]) -> list[list[bytes]]:
    """The distinct words of each text, of two symbols or more."""
    out: list[list[bytes]] = []
    for _, slab in slabs(texts, apart=True):
        stream, first, sizes, owner = read_words(slab)
        raw = stream.astype(np.uint8).tobytes()
        found: list[set[bytes]] = [set() for _ in range(len(slab))]
        for a, n, o in zip(first.tolist(), sizes.tolist(), owner.tolist()):
            if n > 1:
                found[o].add(raw[a : a + n])
        out += [sorted(f) for f in found]
    return out


def fit(texts: list[str], labels: list[int], sample: Sample = Sample(), seed: int = 11) -> Model:
    y = np.array(labels, bool)
    empty = np.zeros(1 << 20, np.float32)
    if y.all() or not y.any():
        return Model(empty, 0.0, np.zeros(FEATURES + 1), float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    documents = _documents(texts)
    words = sorted(set().union(*documents))
    if not words:
        return Model(empty, 0.0, np.zeros(FEATURES + 1), float(y.mean()))
    number = {w: i for i, w in enumerate(words)}
    held = [np.fromiter(map(number.__getitem__, d), np.int64, len(d)) for d in documents]
    del documents, number
    stream = np.frombuffer(b"\0\0" + b"\0\0".join(words) + b"\0\0\0\0", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = 2 * np.arange(1, len(words) + 1) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Where to start: subsequences without a gap that more toxic documents have than clean ones.
    plain = (stream[:-3] << 15 | stream[1:-2] << 10 | stream[2:-1] << 5 | stream[3:]).astype(np.int32)
    seen = np.zeros((2, 1 << 20), np.float32)
    for d, toxic in zip(held, y):
        if len(d):
            seen[int(toxic), np.unique(plain[_ragged(first[d] - 1, sizes[d] - 1)])] += 1
    rate = (seen + 0.5) / (np.array([[(~y).sum()], [y.sum()]]) + 1)
    lift = (np.maximum(np.log(rate[1] / rate[0]), 0) * np.sqrt(seen[1])).astype(np.float32)
    total = np.concatenate([[0], np.cumsum(lift[plain], dtype=np.float64)])
    score = (total[first + sizes - 2] - total[first - 1]) / np.maximum(sizes - 1, 1)
    del total, plain, seen, rate, lift
    every_clean = np.concatenate([d for d, t in zip(held, y) if not t] or [np.zeros(0, np.int64)])
    table, bias = empty, 0.0
    for _ in range(sample.rounds):
        positive, n_positive = np.unique([d[score[d].argmax()] for d, t in zip(held, y) if t and len(d)], return_counts=True)
        hard, n_hard = np.unique([d[score[d].argmax()] for d, t in zip(held, y) if not t and len(d)], return_counts=True)
        others = rng.choice(every_clean, min(len(every_clean), 2500), replace=False) if len(every_clean) else every_clean
        if not len(positive) or not len(hard):
            return Model(empty, 0.0, np.zeros(FEATURES + 1), float(y.mean()))
        chosen = np.concatenate([positive, hard, others]).astype(np.int64)
        target = np.repeat([1.0, -1.0], [len(positive), len(hard) + len(others)])
        weight = np.concatenate([n_positive / n_positive.sum(), 0.5 * n_hard / n_hard.sum(), np.full(len(others), 0.5 / max(len(others), 1))])
        half = sample.landmarks // 2
        common = positive[np.argsort(-n_positive, kind="stable")]
        marks = [*common[:half].tolist(), *rng.permutation(hard)[: half // 2].tolist(), *rng.permutation(others)[: half // 2].tolist()]
        mark_bag = Bag([words[int(i)] for i in marks])
        of = np.unique(mark_bag.index)
        phi = mark_bag.dense(of)
        kernel = np.vstack([Bag([words[int(i)] for i in chosen[k : k + 500]]).dense(of) @ phi.T for k in range(0, len(chosen), 500)])
        value, vector = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        w, bias = _svm(kernel @ root, target, weight)
        table = empty.copy()
        table[of] = phi.T @ (root @ w)
        score = word_scores(table, stream, first, sizes) + bias
    evidence = np.vstack([e for _, e in _evidence(texts, table, bias)])
    return Model(table, bias, _calibrate(evidence, y))


def _evidence(texts: list[str], table: np.ndarray, bias: float) -> Iterator[tuple[int, np.ndarray]]:
    """Per text: the decisions of its worst words, worst first, and the logarithm of how many words it has."""
    for at, slab in slabs(texts, 1_000_000, apart=True):
        stream, first, sizes, owner = read_words(slab)
        out = np.full((len(slab), FEATURES), bias)
        out[:, -1] = np.log1p(np.bincount(owner, minlength=len(slab)))
        if len(first):
            decision = word_scores(table, stream, first, sizes) + bias
            decision[sizes < 2] = bias
            order = np.lexsort((-decision, owner))
            begin = np.searchsorted(owner, np.arange(len(slab) + 1))
            for k in range(FEATURES - 1):
                some = np.flatnonzero(np.diff(begin) > k)
                out[some, k] = decision[order[begin[some] + k]]
        out[:, :-1] = np.clip(out[:, :-1], -2, 2)
        yield at, out


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the evidence, with smoothed targets."""
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - target) + ridge @ w)
        w = w - step * min(1, 2 / max(np.abs(step).max(), 1e-9))
    return w


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: Sample = Sample(), allowed: Column | None = None) -> Model:
    """labels: ids and labels, 0 or 1; allowed: a condition on label rows that may be learned from."""
    found = labelled_texts(df, labels, id_col, text_col, label_col, {1: sample.toxic, 0: sample.clean}, sample.chars, allowed)
    return fit([f[1] for f in found], [f[0] for f in found], sample)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, over all words of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, evidence in _evidence(batch.column(1).to_pylist(), model.table, model.bias):
                out = np.full(len(evidence), model.constant or 0.0)
                if model.constant is None:
                    out = 1 / (1 + np.exp(-np.clip(evidence @ model.calibration[:-1] + model.calibration[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out)], names=["doc_id", "score"])

    return mapped(keyed(df, id_col, text_col), step, "doc_id long, score double")
