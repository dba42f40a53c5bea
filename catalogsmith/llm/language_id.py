"""Language of each word, and so of each document, by a linear-chain conditional random field.

A word is a run of letters. Its emission score for a language adds learned weights of its character n-grams (mean over the
word, its boundaries included), its affixes and the word itself (the lexicon), all hashed; learned transitions link
neighbouring words of a line. Forward-backward gives each word its probabilities, so a code-switched text gets its switches;
a document's language is the one with the greatest mean probability over all its words, and that mean is the score.

Training: about ``Sample.documents`` labelled documents of at most ``Sample.chars`` code points, in equal shares for all
languages there are (at least ``Sample.least`` of each), chosen by a hash of id and text among distinct such pairs, so that
repeated rows change nothing. Labels are of documents, so switches are learned from chains made of lines of two languages. A chain is a whole line, however long: its blocks of BLOCK words run
side by side, with exact messages between them. The model has a fixed size: with many languages there are fewer buckets for each.

Null text or one without letters: ``und``, score 0. With no labelled document every text is ``und``. Repeated rows are
repeated; an empty table gives an empty result; only id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkio import keyed, mapped, quoted, with_row
from .textkernel import Slab, letters, lowered, slabs

#: Buckets of features, as a power of two; and weights that a model has at most, if that leaves 2**10 buckets.
BUCKETS_BITS, WEIGHTS_BITS = 16, 22
BLOCK = 256
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Sample:
    documents: int = 1600
    chars: int = 20_000
    least: int = 20
    chains: int = 12_000


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # from x to


def _bucket(*parts: np.ndarray, kind: int) -> np.ndarray:
    total = np.uint64(kind * 0xD6E8FEB86659FD93 & ((1 << 64) - 1))
    for part, factor in zip(parts, _SPREAD):
        total = total + part.astype(np.uint64) * np.uint64(factor)
        total = total ^ (total >> np.uint64(29))
    return (total * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)


class Words:
    """The words of a slab (texts kept apart) and the buckets of their features."""

    def __init__(self, slab: Slab):
        letter = letters(slab.codes)
        low = np.where(letter, lowered(slab.codes), 0).astype(np.uint32)
        self.starts, self.ends, self.owner = slab.runs(letter)
        self.lengths = self.ends - self.starts
        at = np.flatnonzero(letter)
        here, before, after = low[at], low[at - 1], low[np.minimum(at + 1, len(low) - 1)]
        self.grams = (_bucket(before, here, kind=2), _bucket(before, here, after, kind=3))
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        s, e = self.starts, self.ends
        self.whole = tuple(_bucket(slab.hash(a, b, low), kind=k) for k, (a, b) in enumerate(((s, np.minimum(s + 3, e)), (np.maximum(e - 3, s), e), (s, e)), 4))

    def __len__(self) -> int:
        return len(self.starts)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """With fewer buckets than the features were given, these are folded."""
        if not len(self):
            return np.zeros((0, weights.shape[1]), np.float32)
        fold = (1 << BUCKETS_BITS) // len(weights)
        total = np.add.reduceat(weights[self.grams[0] // fold] + weights[self.grams[1] // fold], self.first) / self.lengths[:, None].astype(np.float32)
        for bucket in self.whole:
            total = total + weights[bucket // fold]
        return total

    def learn(self, gradient: np.ndarray, weights: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """An AdaGrad step of all weights that these words have."""
        per_char = np.repeat(gradient / self.lengths[:, None], self.lengths, axis=0)
        buckets = np.concatenate([*self.grams, *self.whole]) // ((1 << BUCKETS_BITS) // len(weights))
        values = np.concatenate([per_char, per_char, gradient, gradient, gradient])
        used, at = np.unique(buckets, return_inverse=True)
        total = np.stack([np.bincount(at, values[:, k], len(used)) for k in range(values.shape[1])], 1)
        squares[used] += total**2
        weights[used] -= (rate * total / np.sqrt(squares[used] + 1e-6)).astype(np.float32)


def chains_of(slab: Slab, words: Words) -> np.ndarray:
    """Where chains begin among the words (and the end): at a new text or line."""
    n = len(words)
    if not n:
        return np.zeros(1, np.int64)
    line = np.concatenate([[0], np.cumsum(slab.codes == 10)])[words.starts]
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | (words.owner[1:] != words.owner[:-1])
    return np.append(np.flatnonzero(new), n)


def messages(emit: np.ndarray, bounds: np.ndarray, move: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts chains into blocks: their bounds, what enters each from the words before it, and what comes back to its last word
    from those after it. A block of a longer chain acts on these as a matrix; all such are multiplied out side by side, word by
    word, and then applied along each chain, block by block."""
    labels = len(move)
    blocks = -(-np.diff(bounds) // block)
    first, total = np.cumsum(blocks) - blocks, int(blocks.sum())
    number = np.arange(total) - np.repeat(first, blocks)
    cuts = np.append(np.repeat(bounds[:-1], blocks) + number * block, bounds[-1])
    enter, leave = np.ones((total, labels)), np.full((total, labels), 1.0 / labels)
    parts = np.flatnonzero(np.repeat(blocks, blocks) > 1)
    if not len(parts):
        return cuts, enter, leave
    lengths = np.diff(cuts)[parts]
    order = np.argsort(-lengths, kind="stable")
    parts, lengths = parts[order], lengths[order]
    acts = np.where((number[parts] == 0)[:, None, None], np.eye(labels), move) * emit[cuts[parts]][:, None, :]
    for t in range(1, block):
        k = np.searchsorted(-lengths, -t, "left")  # blocks longer than t
        now = (acts[:k] @ move) * emit[cuts[parts[:k]] + t][:, None, :]
        acts[:k] = now / now.sum((1, 2), keepdims=True)
    place = np.zeros(total, np.int64)
    place[parts] = np.arange(len(parts))
    order = np.argsort(-blocks, kind="stable")
    heads, counts = first[order], blocks[order]
    out = np.ones((len(heads), labels))
    for j in range(1, int(counts[0])):
        k = np.searchsorted(-counts, -j, "left")  # chains of more than j blocks
        now = np.einsum("ij,ijk->ik", out[:k], acts[place[heads[:k] + j - 1]])
        out[:k] = now / now.sum(1, keepdims=True)
        enter[heads[:k] + j] = out[:k] @ move
    for j in range(int(counts[0]) - 1, 0, -1):
        at = heads[: np.searchsorted(-counts, -j, "left")] + j
        now = np.einsum("ijk,ik->ij", acts[place[at]], leave[at])
        leave[at - 1] = now / now.sum(1, keepdims=True)
    return cuts, enter, leave


def forward_backward(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, pairs: bool = False, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray | None]:
    """Each word's probabilities, for all blocks of all chains side by side; with pairs, which needs whole chains, also the
    expected transitions in total."""
    n, labels = scores.shape
    emit = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64) if n else scores
    move = np.exp(transitions - transitions.max())
    cuts, enter, leave = messages(emit, bounds, move, max(n, 1) if pairs else block)
    lengths = np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths, enter, leave = cuts[:-1][order], lengths[order], enter[order], leave[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # blocks longer than t
    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    for t in range(longest):
        at = begin[: active[t]] + t
        now = enter * emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = now / now.sum(1, keepdims=True)
    expected = np.zeros((labels, labels)) if pairs else None
    for t in range(longest - 1, -1, -1):
        k = active[t + 1] if t + 1 < longest else 0
        at = begin[: active[t]] + t
        back = leave[: len(at)].copy()
        if k:
            ahead = emit[at[:k] + 1] * beta[at[:k] + 1]
            back[:k] = ahead @ move.T
            if pairs:
                both = alpha[at[:k]][:, :, None] * move[None] * ahead[:, None, :]
                expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
            back[:k] /= back[:k].sum(1, keepdims=True)
        beta[at] = back
    out = alpha * beta
    return out / out.sum(1, keepdims=True) if n else out, expected


def fit(texts: list[str], labels: list[str], chains: int = Sample.chains, epochs: int = 3, seed: int = 7) -> Model:
    """Stochastic gradient steps on the likelihood of chains: lines of one language, and of two joined."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    lines = [(line, names.index(label)) for text, label in zip(texts, labels) for line in text.split("\n") if line.strip()]
    if len(lines) > chains:
        lines = [lines[i] for i in rng.choice(len(lines), chains, replace=False)]
    buckets = 1 << max(10, min(BUCKETS_BITS, WEIGHTS_BITS - (max(len(names), 1) - 1).bit_length()))
    weights, squares = np.zeros((buckets, len(names)), np.float32), np.zeros((buckets, len(names)))
    move, move_squares = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
    for _ in range(epochs if len(names) > 1 else 0):
        shuffled = [lines[i] for i in rng.permutation(len(lines))]
        for k in range(0, len(shuffled), 400):
            lot = shuffled[k : k + 400]
            slab = Slab([x[0] for x in lot], apart=True)
            words = Words(slab)
            if not len(words):
                continue
            truth = np.array([x[1] for x in lot])[words.owner]
            # every fourth line runs on into the next
            begins = np.flatnonzero(np.concatenate([[True], words.owner[1:] != words.owner[:-1]]))
            bounds = np.append(begins[(words.owner[begins] % 4 != 1) | (begins == 0)], len(words))
            found, expected = forward_backward(words.scores(weights), bounds, move, pairs=True)
            gradient = found.copy()
            gradient[np.arange(len(words)), truth] -= 1
            words.learn(gradient, weights, squares, 0.3)
            inner = np.ones(len(words), bool)
            inner[bounds[:-1]] = False
            later = np.flatnonzero(inner)
            seen = np.zeros_like(move)
            np.add.at(seen, (truth[later - 1], truth[later]), 1)
            move_squares += (expected - seen) ** 2
            move -= 0.3 * (expected - seen) / np.sqrt(move_squares + 1e-6)
    return Model(names, weights, move)


def labelled_sample(df: DataFrame, label: Column, text_col: str, id_col: str, sample: Sample) -> tuple[list[str], list[str]]:
    """A bounded number of (text, label) rows, in equal shares for all labels, by a hash of id and text and not by place."""
    text = F.col(quoted(text_col)).cast("string")
    rows = df.select(text.alias("text"), label.cast("string").alias("label"), F.xxhash64(F.col(quoted(id_col)), text).alias("h"))
    rows = rows.where(F.col("label").isNotNull() & (F.length("text") > 0) & (F.length("text") <= sample.chars))
    counts = [(r.label, r["count"]) for r in rows.select("label", "h").distinct().groupBy("label").count().collect()]
    if not counts:
        return [], []
    each = max(sample.least, sample.documents // len(counts))
    limits = [(name, int((min(1.0, 1.3 * each / n) - 0.5) * 1.9999 * 2**63)) for name, n in counts]
    known = F.broadcast(df.sparkSession.createDataFrame(limits, "name string, most long"))  # a row for each language
    chosen = rows.join(known, (F.col("label") == F.col("name")) & (F.col("h") <= F.col("most")))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    one = chosen.groupBy("label", "h").agg(F.min("text").alias("text")).withColumn("place", place).where(F.col("place") <= each)
    found = sorted((r.h, r.label, r.text) for r in one.collect())
    return [f[2] for f in found], [f[1] for f in found]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: Sample = Sample()) -> Model:
    """Learns from all rows given: leave out those that are to be held out."""
    texts, labels = labelled_sample(df, F.col(quoted(lang_col)), text_col, id_col, sample)
    return fit(texts, labels, sample.chains)


def word_languages(model: Model, text: str) -> list[tuple[str, str]]:
    """Each word and its most probable language."""
    slab = Slab([text], apart=True)
    words = Words(slab)
    found, _ = forward_backward(words.scores(model.weights), chains_of(slab, words), model.transitions)
    return [(text[a:b], model.languages[k]) for a, b, k in zip(words.starts, words.ends, found.argmax(1))]


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and n_switches (between neighbouring words of a line); with keep, also row: a struct of all of
    df's columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for first, slab in slabs(batch.column(1).to_pylist(), 1_000_000, apart=True):
                m = len(slab)
                words = Words(slab)
                best, score, switches = np.full(m, len(names) - 1), np.zeros(m), np.zeros(m, np.int64)
                if len(words) and model.languages:
                    bounds = chains_of(slab, words)
                    found, _ = forward_backward(words.scores(model.weights), bounds, model.transitions)
                    some = np.bincount(words.owner, minlength=m)
                    total = np.stack([np.bincount(words.owner, found[:, k], m) for k in range(found.shape[1])], 1)
                    full = some > 0
                    best[full], score[full] = total[full].argmax(1), np.minimum(total[full].max(1) / some[full], 1)
                    word = found.argmax(1)
                    switch = np.concatenate([[False], word[1:] != word[:-1]])
                    switch[bounds[:-1]] = False
                    switches = np.bincount(words.owner[switch], minlength=m)
                part = batch.slice(first, m)
                columns = [part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(switches), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_switches", "row"][: len(columns)])

    return mapped(keyed(df, id_col, text_col, keep), step, with_row("doc_id long, lang_pred string, score double, n_switches long", df, keep))
