"""How filters of documents interact: what each removes, in every order that they may be applied in.

Every document gets a mask of the filters that it fails. Four of them look at its text alone; the fifth fails a document whose
text is identical to that of one with a smaller id. For that an RDD is routed by fingerprint: a text's xxhash names its
partition, and there a chain for each fingerprint holds full texts (so that two texts of one fingerprint stay two) with their
least ids; ids above the least of their text are emitted as failing. Tasks chain their own texts first, in lots of LOT bytes, and
send one record for each text of a lot, with the masks and counts of its least id; what is above that id is settled there
already and travels without its text. So a text that a third of all documents share costs one record for each lot.

The masks are written to the shared folder, joined to the labels by id, and counted by combineByKey: the value of a part is a
vector of counts over the 32 masks (all documents, good ones and toxic ones), merged within tasks before the shuffle. All
orders and steps of a part are read off its vector.

Null text: empty. An empty text fails none of A to D but A. Null part: the empty string. A document without an id is no copy of
another, nor another of it. Repeated rows count each, and are no copies of one another, since their id is the same. Of several
rows of labels for an id, any that says 1 counts. An empty table has no parts and so no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkio import quoted, written

FILTERS = "ABCDE"
#: The bit of the fifth filter.
COPY = 16
#: Bytes of distinct texts that a task chains before it sends them on, and of text that a partition gets, about.
LOT = 32 << 20


@dataclass(frozen=True)
class Limits:
    """A: fewer words than least_words; B: a lower percentage of distinct words; C: a higher one of capitals A to Z; D: any sign."""

    least_words: int = 100
    distinct: int = 80
    capitals: int = 10
    signs: str = "#$%&*|"

    def mask(self, raw: bytes, code_points: int) -> int:
        words = raw.split()  # at U+0020 and U+0009 to U+000D, as bytes are
        n = len(words)
        capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        sign = re.search(b"[" + re.escape(self.signs.encode()) + b"]", raw) is not None
        return (n < self.least_words) | (100 * len(set(words)) < self.distinct * n) << 1 | (100 * capitals > self.capitals * code_points) << 2 | sign << 3


class Chains:
    """Texts by fingerprint. A chain's entries: the text, its mask, its least id, and the rows of that id by part."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.settled: Counter = Counter()  # (id, part, mask) of rows that are known to fail or pass
        self.size = 0

    def find(self, fingerprint: int, raw: bytes) -> list | None:
        return next((e for e in self.of.get(fingerprint, ()) if e[0] == raw), None)

    def add(self, fingerprint: int, raw: bytes, mask: int, doc_id: int, parts: dict[str, int]) -> None:
        entry = self.find(fingerprint, raw)
        if entry is None:
            self.of.setdefault(fingerprint, []).append([raw, mask, doc_id, Counter(parts)])
            self.size += len(raw) + 200
        elif doc_id == entry[2]:
            entry[3].update(parts)
        elif doc_id > entry[2]:
            self.settle(doc_id, parts, mask | COPY)
        else:
            self.settle(entry[2], entry[3], mask | COPY)
            entry[2], entry[3] = doc_id, Counter(parts)

    def settle(self, doc_id: int | None, parts: dict[str, int], mask: int) -> None:
        for part, n in parts.items():
            self.settled[doc_id, part, mask] += n

    def entries(self) -> Iterator[tuple[int, list]]:
        for fingerprint, chain in self.of.items():
            for entry in chain:
                yield fingerprint, entry


def _spread(doc_id: int | None, part: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc_id}/{part}".encode())


def masks(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", fingerprint=xxhash.xxh3_64_intdigest) -> DataFrame:
    """doc_id, part, mask and n: how many rows of this id and part fail these filters. Copies are told over the whole table."""
    columns = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit("")).alias("part"))
    size = columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def local(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
        chains = Chains()

        def sent() -> Iterator[tuple[int, tuple]]:
            for key, (raw, mask, doc_id, parts) in chains.entries():
                yield key, (raw, mask, doc_id, dict(parts))
            for (doc_id, part, mask), n in chains.settled.items():
                yield _spread(doc_id, part), (None, mask, doc_id, {part: n})

        for doc_id, text, part in rows:
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            key = fingerprint(raw)
            known = chains.find(key, raw)
            mask = known[1] if known else limits.mask(raw, len(text))
            if doc_id is None:
                chains.settle(None, {part: 1}, mask)
            else:
                chains.add(key, raw, mask, doc_id, {part: 1})
            if chains.size > LOT or len(chains.settled) > 200_000:
                yield from sent()
                chains = Chains()
        yield from sent()

    def routed(records: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
        chains = Chains()
        for key, (raw, mask, doc_id, parts) in records:
            if raw is None:
                for part, n in parts.items():
                    yield doc_id, part, mask, n
                continue
            chains.add(key, raw, mask, doc_id, parts)
            if chains.settled:
                for (other, part, failed), n in chains.settled.items():
                    yield other, part, failed, n
                chains.settled.clear()
        for _, (_, mask, doc_id, parts) in chains.entries():
            for part, n in parts.items():
                yield doc_id, part, mask, n

    spark = df.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LOT))
    found = columns.rdd.mapPartitions(local).partitionBy(partitions, lambda key: key).mapPartitions(routed)
    return spark.createDataFrame(found, "doc_id long, part string, mask int, n long")


def vectors(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> RDD:
    """(part, counts): counts of masks over all documents, good ones and toxic ones (3 x 32)."""
    says = lambda c: F.coalesce(F.max(F.col(quoted(c)) == 1), F.lit(False))
    judged = labels.groupBy(F.col(quoted(id_col)).cast("long").alias("labelled")).agg(says(good_col).alias("good"), says(toxic_col).alias("toxic"))
    joined = masked.join(judged, F.col("doc_id") == F.col("labelled"), "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[0, mask] += n
        counts[1, mask] += n * good
        counts[2, mask] += n * toxic
        return counts

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    return joined.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros((3, 32), np.int64), row), add, merge)


def steps(counts: np.ndarray) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for all orders and steps."""
    mask, rows, total = np.arange(32), [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = (mask & bit) > 0, (mask & before) > 0
            removed, good_lost, toxic_lost = (int(v) for v in counts[:, fails & ~gone].sum(1))
            before |= bit
            total[name] += removed
            rows.append(("".join(order), step, int(counts[0, (mask & before) == 0].sum()), removed, int(counts[0, fails & gone].sum()), int(counts[0, bit]), good_lost, toxic_lost, name))
    return [(*r[:-1], total[r[-1]]) for r in rows]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(df: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step."""
    masked = written(masks(df, limits, id_col, text_col, part_col), "audit-masks")
    found = vectors(masked, labels).flatMap(lambda kv: [(kv[0], *row) for row in steps(kv[1])])
    return df.sparkSession.createDataFrame(found, SCHEMA)


#: The same in SQL.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
fails AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM words),
judged AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
masked AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN judged USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
places AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
counted AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before + bit)::INT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before::INT > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masked, places GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
