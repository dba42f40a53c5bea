"""Personal data: patterns, and information-theoretic sanitisation of what gives it away.

Emails, IP addresses, card and telephone numbers are found by pattern, in linear time. A term then counts as revealing if,
over the whole corpus, the texts that hold it near one protected value are most of the texts that hold it at all: with c the
distinct texts with the term within NEAR words of the value, n those with the term (counted exactly for the terms that can
still qualify), e those with the value and N all distinct texts, it must have c >= support, disclosure c / n at least
``generalise``, and at least ``bits`` of pointwise information log2(c N / (n e)). Its occurrences anywhere become [TERM], or
are removed where c / n reaches ``remove``.

Null text: empty, no spans. Repeated rows each give their row, but a text counts once as evidence. An empty table gives an
empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .sparkio import keyed, mapped, quoted, with_row, written
from .textkernel import Slab, letters, lowered, repeated, slabs

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a value that count as its context.
NEAR = 4
#: Revealing terms that are broadcast (12 bytes each); beyond this number they are joined instead.
BROADCAST_TERMS = 1_000_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+").finditer
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NO_SIGNS = str.maketrans("", "", " -().+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


@dataclass(frozen=True)
class Disclosure:
    support: int = 3
    generalise: float = 0.5
    remove: float = 0.9
    bits: float = 4.0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign: the run before it (from the last match on) and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            done = m.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Each four parts of a maximal chain of dotted numbers are a match; it fails if a part is over 255."""
    out = []
    for m in _DOTTED(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 or len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(_DOUBLED[int(d)] for d in back[1::2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _DIGITS(text) if m.end() - m.start() >= 16 and 16 <= len(d := m[0].translate(_NO_SIGNS)) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE(text) if 8 <= len(m[0].translate(_NO_SIGNS)) <= 15] if "+" in text else []


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind."""
    return [emails(text), ips(text), cards(text), phones(text)]


def _terms(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text numbers and hashes of terms: words without signs at their ends, in lower case, of four letters or more."""
    starts, ends, owner = slab.words()
    letter = letters(slab.codes)
    solid = np.flatnonzero(letter | (slab.codes - np.uint32(ord("0")) < 10))
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = high > low
    starts, ends, owner = solid[low[some]], solid[high[some] - 1] + 1, owner[some]
    upto = np.concatenate([[0], np.cumsum(letter)])
    good = (upto[ends] - upto[starts]) >= 4
    starts, ends, owner = starts[good], ends[good], owner[good]
    return starts, ends, owner, slab.hash(starts, ends, lowered(slab.codes)).view(np.int64)


EVIDENCE = pa.schema([("value", pa.int64()), ("term", pa.int64()), ("text", pa.int64())])


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of value and near term, by text (term 0: the value itself); and a row without value for every text."""
    for batch in batches:
        values, terms, texts = [], [], []
        for _, slab in slabs(batch.column(0).to_pylist()):
            starts, ends, owner, hashes = _terms(slab)
            for k, text in enumerate(slab.texts):
                own, first = _digest(text), slab.bounds[k]
                values.append(None)
                terms.append(None)
                texts.append(own)
                found = base_spans(text)
                if not any(found):
                    continue
                for kind, spans in zip(KINDS, found):
                    for a, b in spans:
                        value = _digest(f"{kind}:{text[a:b].lower()}")
                        low, high = np.searchsorted(ends, first + a, "right"), np.searchsorted(starts, first + b, "left")
                        near = {*range(max(low - NEAR, 0), low), *range(high, min(high + NEAR, len(starts)))}
                        for h in {int(hashes[i]) for i in near if owner[i] == k}:
                            values.append(value)
                            terms.append(h)
                            texts.append(own)
                        values.append(value)
                        terms.append(0)
                        texts.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (values, terms, texts)], schema=EVIDENCE)


def _frequencies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """term and n, the number of distinct texts with it, for the wanted terms: broadcast if few, else joined."""
    known = None
    if wanted.count() <= BROADCAST_TERMS:
        known = texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r.term for r in wanted.collect()], np.int64)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist()):
                _, _, owner, hashes = _terms(slab)
                if known is not None:
                    some = np.isin(hashes, known.value)
                    owner, hashes = owner[some], hashes[some]
                _, later = repeated(hashes.view(np.uint64), owner)
                own = np.zeros(len(slab), np.int64)
                for k in np.unique(owner):
                    own[k] = _digest(slab.texts[k])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[~later], pa.int64()), pa.array(own[owner[~later]], pa.int64())], names=["term", "text"])

    held = mapped(texts, step, "term long, text long")
    return (held if known is not None else held.join(wanted, "term", "left_semi")).distinct().groupBy("term").agg(F.count("*").alias("n"))


def revealing_terms(df: DataFrame, text_col: str = "text", limits: Disclosure = Disclosure()) -> DataFrame:
    """term (hash, long) and removed (boolean: disclosure at or over limits.remove)."""
    texts = df.select(F.col(quoted(text_col)).cast("string").alias("text"))
    found = written(mapped(texts, _evidence, "value long, term long, text long"), "pii-evidence")
    documents = found.where("value is null").select("text").distinct().count()
    evidence = found.where("value is not null")
    pairs = evidence.distinct().groupBy("value", "term").agg(F.count("*").alias("c"))
    values = pairs.where("term = 0").select("value", F.col("c").alias("e"))
    # The texts with a term near any value are at most its n: what fails by these alone is not counted in all documents.
    least = evidence.where("term != 0").select("term", "text").distinct().groupBy("term").agg(F.count("*").alias("least"))
    enough = pairs.where((F.col("term") != 0) & (F.col("c") >= limits.support)).join(least, "term").where(F.col("c") / F.col("least") >= limits.generalise)
    likely = written(enough.join(values, "value").select("term", "c", "e"), "pii-likely")
    counted = likely.join(_frequencies(texts, likely.select("term").distinct()), "term")
    share = F.col("c") / F.greatest("n", "c")
    information = F.log2(share * documents / F.col("e")) if documents else F.lit(0.0)
    shown = counted.where((share >= limits.generalise) & (information >= limits.bits))
    return written(shown.groupBy("term").agg((F.max(share) >= limits.remove).alias("removed")), "pii-terms")


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, clean string"


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Disclosure = Disclosure(), terms: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """The columns of SPANS (clean: the text with values and revealing terms replaced) and row, a struct of all of df's columns;
    the last two only with_text."""
    spark = df.sparkSession
    terms = revealing_terms(df, text_col, limits) if terms is None else terms
    source = keyed(df, id_col, text_col, with_text)
    few = None
    if terms.count() <= BROADCAST_TERMS:
        rows = sorted((r.term, r.removed) for r in terms.collect())
        few = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool)))
        source = source.select("doc_id", "text", F.lit(None).cast("array<long>").alias("terms"), F.lit(None).cast("array<boolean>").alias("gone"), *(["row"] if with_text else []))
    else:
        source = _joined_terms(source, terms)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = None if few is not None else (batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for first, slab in slabs(batch.column(1).to_pylist()):
                starts, ends, owner, hashes = _terms(slab)
                if few is not None:
                    known, gone = few.value
                    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                    removed = gone[at] if len(known) else hit
                else:
                    maps = [dict(zip(a or [], b or [])) for a, b in zip(*(x[first : first + len(slab)] for x in listed))]
                    level = [maps[o].get(h) for o, h in zip(owner.tolist(), hashes.tolist())]
                    hit, removed = np.array([x is not None for x in level], bool), np.array([bool(x) for x in level], bool)
                spots: dict[int, list[tuple[int, int, bool]]] = {}
                for i in np.flatnonzero(hit):
                    k = int(owner[i])
                    spots.setdefault(k, []).append((int(starts[i] - slab.bounds[k]), int(ends[i] - slab.bounds[k]), bool(removed[i])))
                out: list[tuple] = []
                for k, text in enumerate(slab.texts):
                    base = base_spans(text)
                    covered = [s for spans in base for s in spans]
                    more = [s for s in spots.get(k, []) if all(s[1] <= a or b <= s[0] for a, b in covered)]
                    said = [f"{kind}:{a}:{b}" for kind, spans in zip(KINDS, base) for a, b in spans]
                    every = ",".join([*said, *(f"term:{a}:{b}" for a, b, _ in more)])
                    marks = [(a, b, f"[{kind.upper()}]") for kind, spans in zip(KINDS, base) for a, b in spans] + [(a, b, "" if gone_ else "[TERM]") for a, b, gone_ in more]
                    out.append((*map(len, base), hashlib.sha256(",".join(said).encode()).hexdigest(), every, len(more), replaced(text, marks) if with_text else None))
                columns = [batch.column(0).slice(first, len(slab)), *(pa.array([o[i] for o in out], pa.string() if i in (4, 5, 7) else pa.int64()) for i in range(8)), *(c.slice(first, len(slab)) for c in batch.columns[4:])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "clean", "row"][: len(columns)])

    out = mapped(source, step, with_row(SPANS, df, with_text))
    return out if with_text else out.drop("clean")


def replaced(text: str, marks: list[tuple[int, int, str]]) -> str:
    """The text with marked spans replaced; of spans that overlap, their union takes the mark of the first."""
    if not marks:
        return text
    parts, at, end = [], 0, -1
    for a, b, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a < end:
            end = max(end, b)
        else:
            if end >= 0:
                at = end
            parts += [text[at:a], mark]
            end = b
    return "".join([*parts, text[end:]])


def _joined_terms(source: DataFrame, terms: DataFrame) -> DataFrame:
    """The way for more terms than are broadcast: distinct terms of each text are joined to the revealing ones."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist()):
                _, _, owner, found = _terms(slab)
                own = np.array([_digest(t) for t in slab.texts], np.int64)
                _, later = repeated(found.view(np.uint64), owner)
                yield pa.RecordBatch.from_arrays([pa.array(own[owner[~later]]), pa.array(found[~later])], names=["own", "term"])

    pairs = mapped(source.select("text"), hashes, "own long, term long").join(terms, "term").distinct()
    by_text = pairs.groupBy("own").agg(F.collect_list("term").alias("terms"), F.collect_list("removed").alias("gone"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([_digest(t or "") for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "own"])

    kept = source.columns[2:]
    texts = mapped(source, digests, StructType([*source.schema.fields, StructField("own", LongType())]))
    return texts.join(by_text, "own", "left").select("doc_id", "text", "terms", "gone", *kept)
