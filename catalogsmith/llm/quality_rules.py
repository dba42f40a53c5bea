"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of each reference
language by the Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. The references are the mean
histograms of all documents of a language in the corpus itself, so they take one pass and a fixed number of sums. A document
too short for its histogram to mean anything is not judged by it (the minimum-length guards).

Null or empty text: no words, so base_failed and not kept. Repeated rows each give their row. A null or unknown language
joins no reference. An empty table gives an empty result, and with no reference at all nothing diverges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkio import keyed, mapped, quoted
from .textkernel import Slab, lookup, lowered, repeated, slabs, windows

#: Frequent function words of each reference language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was with be as by are this at from or an have not but he his they which you".split(),
    "fr": "de la le et les des en un une du que dans qui par pour au sur pas plus ce il est elle avec se sont ne aux son ou".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wie".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
}
#: The contract's symbols.
SYMBOLS = "#*$%&|<>"
LANGUAGES = tuple(COMMON_WORDS)
WORDS = tuple(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
#: Lower-case letter, upper-case letter, letter beyond ASCII, digit, white space, sentence mark, symbol, any other.
CLASSES = 8


@dataclass(frozen=True)
class Rules:
    """Largest distances from the nearest language, and the words a document needs to be judged by each."""

    max_chars: float = 0.33
    max_words: float = 0.50
    min_words_chars: int = 20
    min_words_words: int = 60


def _class_table() -> np.ndarray:
    kind = np.full(0x10000, 7, np.int64)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    beyond = np.arange(0x10000) >= 128
    kind[beyond & lookup("letter", np.arange(0x10000, dtype=np.uint32), False)] = 2
    kind[ord("0") : ord("9") + 1] = 3
    for space in " \t\n\v\f\r":
        kind[ord(space)] = 4
    for mark in ".,;:!?'\"()-":
        kind[ord(mark)] = 5
    for symbol in SYMBOLS:
        kind[ord(symbol)] = 6
    return kind


_made: dict[str, object] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _made:
        words = Slab(list(WORDS))
        hashes = words.hash(words.bounds[:-1], words.bounds[1:])
        order = np.argsort(hashes)
        _made["all"] = (_class_table(), hashes[order], order)
    return _made["all"]  # type: ignore[return-value]


def _histograms(slab: Slab, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: counts of character classes, and of common words (the last bin: all other words)."""
    kind, hashes, order = _tables()
    m = len(slab)
    of = np.repeat(np.arange(m), np.diff(slab.bounds))
    chars = np.bincount(of * CLASSES + kind[np.minimum(slab.codes, 0xFFFF)], minlength=m * CLASSES).reshape(m, CLASSES)
    bins = len(WORDS) + 1
    low = lowered(slab.codes)
    found = slab.hash(starts, ends, low)
    place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    which = np.where(hashes[place] == found, order[place], len(WORDS))
    words = np.bincount(owner * bins + which, minlength=m * bins).reshape(m, bins)
    return chars, words


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance of each row of p from the one distribution q: the root of the divergence in bits."""
    half = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / half), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / half), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def language_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The mean histograms of each reference language over all documents; 4 languages of fixed histograms reach the driver."""
    size = CLASSES + len(WORDS) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(LANGUAGES), size)), np.zeros(len(LANGUAGES), np.int64)
        for batch in batches:
            langs = np.array([LANGUAGES.index(x) if x in LANGUAGES else -1 for x in batch.column(1).to_pylist()])
            for first, slab in slabs(batch.column(0).to_pylist()):
                starts, ends, owner = slab.words()
                chars, words = _histograms(slab, starts, ends, owner)
                both = np.hstack([_shares(chars), _shares(words)])
                of = langs[first : first + len(slab)]
                for k in range(len(LANGUAGES)):
                    mine = (of == k) & (words.sum(1) > 0)
                    total[k] += both[mine].sum(0)
                    n[k] += mine.sum()
        yield pa.RecordBatch.from_pydict({"lang": pa.array(range(len(LANGUAGES)), pa.int32()), "n": pa.array(n), "total": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = mapped(df.select(F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang")), sums, "lang int, n long, total array<double>")
    added = parts.groupBy("lang").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)))
    found = {}
    for row in added.collect():
        if row.n:
            mean = np.array([row[f"t{i}"] for i in range(size)]) / row.n
            found[LANGUAGES[row.lang]] = (mean[:CLASSES], mean[CLASSES:])
    return found


def _base(slab: Slab, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    m, n = len(slab), len(starts)
    n_words = np.bincount(owner, minlength=m)
    length = np.bincount(owner, ends - starts, minlength=m).astype(np.int64)
    kind = _tables()[0]
    at = np.flatnonzero(kind[np.minimum(slab.codes, 127)] * (slab.codes < 128) == 6)
    symbols = np.bincount(slab.owner(at), minlength=m)
    word_hashes = slab.hash(starts, ends)
    begin, hashes = windows(word_hashes, owner, 8)
    twice, _ = repeated(hashes, owner[begin])
    cover = np.zeros(n + 9, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + 8, -1)
    inside = np.cumsum(cover)[:n] > 0
    repeats = np.bincount(owner[inside], minlength=m)
    breaks = np.flatnonzero(slab.codes == 10)
    line_starts = np.concatenate([slab.bounds[:-1], breaks + 1])
    line_ends = np.concatenate([breaks, slab.bounds[1:]])
    line_starts.sort()
    line_ends.sort()
    of = np.repeat(np.arange(m), np.bincount(slab.owner(breaks), minlength=m) + 1)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, of = line_starts[full], line_ends[full], of[full]
    _, later = repeated(slab.hash(line_starts, line_ends), of)
    lines = np.bincount(of[later], minlength=m)
    return {"n_words": n_words, "word_chars": length, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double, nearest_lang string"


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules(), references: dict | None = None) -> DataFrame:
    """A row per document: the base counts, both distances from the nearest language, and whether it is kept."""
    references = language_references(df, text_col, lang_col) if references is None else references
    names = sorted(references)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, slab in slabs(batch.column(1).to_pylist()):
                starts, ends, owner = slab.words()
                out = _base(slab, starts, ends, owner)
                chars, words = map(_shares, _histograms(slab, starts, ends, owner))
                n = out["n_words"]
                failed = (n < 20) | (100 * out["n_repeat_words"] > 30 * n)
                js_chars, js_words, nearest = np.zeros(len(slab)), np.zeros(len(slab)), np.full(len(slab), None, object)
                if names:
                    by_char = np.stack([jensen_shannon(chars, references[k][0]) for k in names])
                    by_word = np.stack([jensen_shannon(words, references[k][1]) for k in names])
                    best = (by_char + by_word).argmin(0)
                    some = n > 0
                    js_chars[some], js_words[some] = (x[best, np.arange(len(slab))][some] for x in (by_char, by_word))
                    nearest[some] = np.array(names, object)[best[some]]
                far = (js_chars > rules.max_chars) & (n >= rules.min_words_chars) | (js_words > rules.max_words) & (n >= rules.min_words_words)
                ids = batch.column(0).slice(first, len(slab))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x.astype(np.int64)) for x in out.values()), pa.array(failed), pa.array(~failed & ~far), pa.array(js_chars), pa.array(js_words), pa.array(nearest, pa.string())],
                    names=["doc_id", *out, "base_failed", "kept", "js_chars", "js_words", "nearest_lang"],
                )

    return mapped(keyed(df, id_col, text_col), step, SCHEMA)
