"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its windows of WIDTH words (lower case; a text of fewer words is one shingle). A shingle weighs its
count in the text times its inverse document frequency, the frequencies coming from a count-min sketch over all documents
(8 MB, whatever the corpus; rarer shingles than it resolves weigh about alike at every size), rounded to steps of 2**STEP so
that sampling can use a table. The inverse frequency is smoothed to lie between 1 and 1 + SPREAD: an edit in one of thousands
of near copies is a rare shingle among common ones, and must not weigh many times as much as these. Improved consistent
weighted sampling draws from each hash function one (shingle, level) pair, equal for two texts with a probability that is
their weighted Jaccard similarity. Bands of ROWS samples put texts in buckets; at the least similarity a pair shares none of
BANDS with a chance of 0.0004, at 0.85 of 0.000008.

Exact copies collapse first, by a 128-bit digest. Then come rounds. In the first, every text of a bucket is paired with one
leader of it (a crowded bucket is dealt to parts of CROWD texts with a leader each, and these leaders are paired in turn). In
the others, the texts of each part stand in an order of their samples, another one each round, and each is compared with the
REACH before it that are of other classes. So a bucket costs a row a text, never all its pairs. Pairs are sieved by their
samples (four bits of each: a pair at the least similarity falls through with a chance of 0.000005) and the likeliest of each
text (in later rounds, of each text and bucket) is verified: by weighted Jaccard similarity of the whole texts' shingles, which
are made once for each text concerned and sent as 32-bit hashes and levels (two different shingles of a pair agree by chance
once in 2**32 over their number). Texts found alike join in classes. Rounds end with one that
brings next to none (``Likeness.settled``; at 0, none). Then every pair of a bucket's texts that still are of different classes
is compared, in cells of CELL by CELL texts to which each text's shingles are sent once, so rounds only spare work. Nothing about
documents is gathered on the driver, and no pair is dropped for crowding.

Null texts and texts without a word are classes of their own. Copies of a row (same id) share its class; of an id with several
texts the one of least digest stands for it. Ties do not matter: a class is numbered by its least doc_id. Only the id and text
columns are read, so names of others may clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sketch import BLOCK_SCHEMA, Counts, block_batches, frequency, summed
from .sparkio import keyed, mapped, removed, written
from .textkernel import U64, Slab, lowered, mix64, repeated, slabs, windows

WIDTH = 5
BANDS, ROWS = 20, 5
#: Samples of which four bits each are kept to sieve pairs, in words of 64 bits; and how many must agree. Of a pair at similarity
#: 0.8, 78 agree in the mean (chance agreements included) with a deviation of 3.8.
SIEVE, SIEVE_WORDS, AGREE = 96, 6, 60
#: Texts of a bucket that share one leader.
CROWD = 2000
#: Texts on either side of a cell in which what the rounds left is compared.
CELL = 500
#: Places that a text is compared over in the later rounds.
REACH = 48
#: See Likeness.settled.
SETTLED = 0.005
#: How much more a shingle that no other document has weighs than one that all have.
SPREAD = 0.25
#: Weights are powers of 2**STEP; levels are the exponents, from 0 on. Levels under TABLE come from a table, others by formula.
STEP, TABLE = 1 / 32, 128
_POOL_BITS = 13
_tables: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Likeness:
    similarity: float = 0.8
    #: Rounds end with one that brings no more than this share of all links; at 0 with one that brings none.
    settled: float = SETTLED


def _pool() -> np.ndarray:
    """Random draws (r, ln c, beta), a column each place."""
    if "pool" not in _tables:
        rng = np.random.default_rng(20240601)
        size = 1 << _POOL_BITS
        _tables["pool"] = np.stack([rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.uniform(0, 1, size)])
    return _tables["pool"]


def draw(level: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For a level and a place in the pool: ln a as 32 sortable bits (the least wins), then t, scrambled, in the lower 32."""
    r, log_c, beta = _pool()[:, place]
    t = np.floor(level * (STEP * np.log(2)) / r + beta)
    bits = (log_c - r * (t - beta) - r).astype(np.float32).view(np.uint32)
    order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return order.astype(U64) << U64(32) | (t.astype(np.int64).astype(U64) * U64(0x9E3779B1) & U64(0xFFFFFFFF))


def _draws() -> np.ndarray:
    """draw() of all levels under TABLE and all places, in one row."""
    if "draws" not in _tables:
        level, place = np.divmod(np.arange(TABLE << _POOL_BITS), 1 << _POOL_BITS)
        _tables["draws"] = draw(level, place)
    return _tables["draws"]


def shingles(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle of every text, in the order of texts."""
    starts, ends, owner = slab.words()
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(U64), none
    hashes = slab.hash(starts, ends, lowered(slab.codes))
    at, found = windows(hashes, owner, WIDTH)
    of = owner[at]
    per = np.bincount(owner, minlength=len(slab))
    if (short := (per > 0) & (per < WIDTH)).any():
        first = np.searchsorted(owner, np.flatnonzero(short))
        whole = hashes[first].copy()
        for j in range(1, WIDTH - 1):
            more = per[short] > j
            whole[more] = mix64(whole[more] * U64(0x9E3779B97F4A7C15) + hashes[first[more] + j])
        found, of = np.concatenate([found, whole]), np.concatenate([of, np.flatnonzero(short)])
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    twice, later = repeated(found, of)
    count = np.ones(len(found), np.int64)
    if later.any():
        marked = np.flatnonzero(twice)
        order = marked[np.lexsort((found[marked], of[marked]))]
        new = np.ones(len(order), bool)
        new[1:] = (found[order][1:] != found[order][:-1]) | (of[order][1:] != of[order][:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        first = order[begin]  # lexsort is stable, so this is the first in the text
        later = np.zeros(len(found), bool)
        later[order] = True
        later[first] = False
        count[first] = size
    return of[~later], found[~later], count[~later]


def levels(found: np.ndarray, count: np.ndarray, sketch: np.ndarray, documents: int) -> np.ndarray:
    """The weight of each shingle as an exponent of 2**STEP."""
    rarity = np.log((documents + 1) / (frequency(sketch, found) + 1.0).clip(max=documents + 1)) / np.log(documents + 2)
    return np.round(np.log2(count * (1 + SPREAD * rarity)) / STEP).astype(np.int64).clip(min=0)


def samples(of: np.ndarray, found: np.ndarray, level: np.ndarray, texts: int, first: int, number: int) -> np.ndarray:
    """texts x number samples of the hash functions from first on, 32 bits each; 0 for texts without shingles."""
    out = np.zeros((texts, number), U64)
    if not len(of):
        return out
    table, low = _draws(), U64(0xFFFFFFFF)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    heavy = np.flatnonzero(level >= TABLE)
    base = np.where(level < TABLE, level, 0) << _POOL_BITS
    mixed = mix64(found)
    turned, place, key = np.empty_like(mixed), np.empty_like(mixed), np.empty_like(mixed)
    at = place.view(np.int64)
    for k in range(number):
        np.multiply(mixed, U64((0x9E3779B97F4A7C15 * (2 * (k + first) + 3) ^ 0x5851F42D4C957F2D | 1) & (1 << 64) - 1), out=turned)
        np.right_shift(turned, U64(64 - _POOL_BITS), out=place)
        here = at[heavy].copy()
        np.add(at, base, out=at)
        np.take(table, at, out=key, mode="clip")
        if len(heavy):
            key[heavy] = draw(level[heavy], here)
        np.right_shift(turned, U64(7), out=turned)
        np.bitwise_and(turned, low, out=turned)
        np.bitwise_xor(key, turned, out=key)
        out[of[begin], k] = np.minimum.reduceat(key, begin) & low
    return out


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band."""
    keys = np.zeros((len(sampled), bands), U64)
    for b in range(bands):
        for k in range(rows):
            keys[:, b] = mix64(keys[:, b] * U64(0xC2B2AE3D27D4EB4F) + sampled[:, b * rows + k] + U64(b + 1))
    return keys.view(np.int64)


def sieve_words(sampled: np.ndarray) -> np.ndarray:
    """Four bits of each of the first SIEVE samples, 16 to a word."""
    bits = (mix64(sampled[:, :SIEVE]) >> U64(60)).reshape(len(sampled), SIEVE_WORDS, 16)
    return np.bitwise_or.reduce(bits << (U64(4) * np.arange(16, dtype=U64)), axis=2).view(np.int64)


def _agreeing(a: Column, b: Column) -> Column:
    """How many of the samples in two arrays of sieve words agree: groups of four bits that are zero in their difference."""
    total = F.lit(0)
    for k in range(SIEVE_WORDS):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, as sorted hashes and weights: the sum of lesser over the sum of greater weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def weighted_sets(slab: Slab, sketch: np.ndarray, documents: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's shingles as ascending 32-bit hashes and their levels (of two with one hash, the greater level)."""
    of, found, count = shingles(slab)
    level = levels(found, count, sketch, documents)
    short = (mix64(found) >> U64(32)).astype(np.uint32)
    order = np.lexsort((-level, short, of))
    of, short, level = of[order], short[order], level[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (short[1:] != short[:-1])
    of, short, level = of[new], short[new], level[new].astype(np.uint16)
    bounds = np.searchsorted(of, np.arange(len(slab) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield short[a:b], level[a:b]


def weights(level: np.ndarray) -> np.ndarray:
    return np.exp2(level * STEP)


def _weighted(text: str, sketch: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    found, level = next(weighted_sets(Slab([text]), sketch, documents))
    return found, weights(level)


def document_frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch of shingles over all documents of (doc_id, text)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist()):
                counts.add(shingles(slab)[1], len(slab))
        yield from block_batches(counts)

    return summed(mapped(df.select("text"), step, BLOCK_SCHEMA))


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, class) of every node in links (a, b): each round takes the least class of the neighbours and then that class's own
    class, until no class changes. Links here are near-stars, so rounds are few."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-both")
    now = written(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("class")).withColumnRenamed("a", "id"), f"{name}-round")
    while True:
        offered = both.join(now, both.b == now.id).groupBy("a").agg(F.min("class").alias("offer"))
        lesser = now.join(offered, now.id == offered.a, "left").select("id", F.col("class").alias("old"), F.least("class", "offer").alias("class"))
        up = now.select(F.col("id").alias("up"), F.col("class").alias("above"))
        jumped = lesser.join(up, lesser["class"] == up.up, "left").select("id", "old", F.least("class", "above").alias("class"))
        after = written(jumped, f"{name}-round")
        changed = after.where(F.col("class") != F.col("old")).limit(1).count()
        removed(now)
        now = after.select("id", "class")
        now._written = after._written
        if not changed:
            removed(both)
            return now


def _merged(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """Classes (id, class) after one step along new links: a class takes the number of the least class that it meets. What takes
    more steps is left to the components at the end."""
    one, other = (grouped.select(F.col("id").alias(f"id_{x}"), F.col("class").alias(f"class_{x}")) for x in "ab")
    met = found.join(one, found.a == F.col("id_a"), "left").join(other, found.b == F.col("id_b"), "left")
    met = met.select("a", "b", F.coalesce("class_a", "a").alias("c"), F.coalesce("class_b", "b").alias("d"))
    step = met.groupBy(F.greatest("c", "d").alias("from")).agg(F.min(F.least("c", "d")).alias("to"))
    new = met.select(F.col("a").alias("id"), F.col("c").alias("class")).union(met.select("b", "d")).distinct()
    every = grouped.union(new).distinct()
    return every.join(step, every["class"] == step["from"], "left").select("id", F.coalesce("to", "class").alias("class"))


def signatures(docs: DataFrame, sketch, documents: int) -> DataFrame:
    """doc_id, a 128-bit digest of the text, the keys of its bands and its sieve words (null for a text without words)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, slab in slabs(batch.column(1).to_pylist(), 1_000_000):
                of, found, count = shingles(slab)
                sampled = samples(of, found, levels(found, count, sketch.value, documents), len(slab), 0, BANDS * ROWS)
                full = np.bincount(of, minlength=len(slab)) > 0
                columns = [pa.array([_digest(t) if f else None for t, f in zip(slab.texts, full)], pa.binary())]
                for listed in (band_keys(sampled, BANDS, ROWS), sieve_words(sampled)):
                    bounds = np.concatenate([[0], np.cumsum(full) * listed.shape[1]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(~full, False)), pa.array(listed[full].ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(slab)), *columns], names=["doc_id", "digest", "bands", "sieve"])

    return mapped(docs, step, "doc_id long, digest binary, bands array<long>, sieve array<long>")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sets(docs: DataFrame, ids: DataFrame, sketch, documents: int) -> DataFrame:
    """id, digest, hashes and levels of the texts of these ids; a row for each row of the documents."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, slab in slabs(batch.column(1).to_pylist(), 1_000_000):
                pairs = [(a.tobytes(), b.tobytes()) for a, b in weighted_sets(slab, sketch.value, documents)]
                columns = [pa.array([_digest(t) for t in slab.texts], pa.binary()), *(pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(slab)), *columns], names=["id", "digest", "hashes", "levels"])

    wanted = docs.where("text is not null").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return mapped(wanted, step, "id long, digest binary, hashes binary, levels binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar. The sets of b's followers are sent after that of b itself to one
    task and read as a stream, so that no group is held."""
    needs = pairs.select(F.col("b").alias("leader"), F.lit(1).alias("follows"), F.col("a").alias("id")).union(pairs.select("b", F.lit(0), "b").distinct())
    sent = needs.join(sets, "id").repartition("leader").sortWithinPartitions("leader", "follows", "id", "digest")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, known = None, None, None
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for leader, follows, i, hashes, levels_ in zip(*(c.to_pylist() for c in batch.columns)):
                if leader == group and (follows, i) == last:
                    continue  # a repeated row
                found = np.frombuffer(hashes, np.uint32), weights(np.frombuffer(levels_, np.uint16))
                if leader != group:
                    group, known = leader, found
                elif weighted_jaccard(found, known) >= similarity:
                    kept.append((i, leader))
                last = (follows, i)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    return mapped(sent.select("leader", "follows", "id", "hashes", "levels"), step, "a long, b long")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each text of a bucket's part with the part's least text, and the least texts of the parts with the least of them."""

    def led(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("b", F.min("id").over(Window.partitionBy(*by)))

    parts = led(members, "band", "part")
    leaders = led(parts.where((F.col("n") > CROWD) & (F.col("id") == F.col("b"))), "band")
    return parts.union(leaders).where("id != b").select(F.col("id").alias("a"), "b").distinct()


def _near_by(left: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each text and bucket the likeliest text of another class that stands up to REACH places before it in its part
    of the bucket. Places go by a word of samples, from another sample on in each turn, so that like texts stand close."""
    word = F.col("sieve")[turn % SIEVE_WORDS]
    bits = 4 * (turn // SIEVE_WORDS % 16)
    word = F.shiftleft(word, bits).bitwiseOR(F.shiftrightunsigned(word, 64 - bits)) if bits else word
    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / CROWD))
    rows = left.withColumn("part", part).withColumn("place", word)
    before = Window.partitionBy("band", "part").orderBy("place", "id").rowsBetween(-REACH, -1)
    rows = rows.withColumn("others", F.collect_list(F.struct("id", "class", "sieve")).over(before))
    others = F.filter("others", lambda x: x["class"] != F.col("class"))
    best = F.array_max(F.transform(others, lambda x: F.struct(_agreeing(F.col("sieve"), x["sieve"]).alias("agree"), (-x["id"]).alias("b"))))
    likely = rows.select(F.col("id").alias("a"), best.alias("best")).where(F.col("best.agree") >= AGREE)
    return likely.select("a", (-F.col("best.b")).alias("b")).distinct()


def _dealt(left: DataFrame) -> DataFrame:
    """cell, side, id, class, in_main: the texts of buckets that hold several classes, dealt to cells so that every pair of a bucket's
    texts of different classes meets in one. One of the two is outside the bucket's largest class; such texts are side 0, at most
    about CELL of them to a cell, and side 1 holds all, at most about CELL too. So a text is sent to a cell once, not once a pair."""
    sizes = left.groupBy("band", "class").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("band").agg(F.max_by("class", F.struct("size", "class")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"), F.count("*").alias("classes")).where("classes > 1")
    deal = lambda n: F.greatest(F.ceil(n / CELL), F.lit(1)).cast("int")
    rows = left.join(largest, "band").withColumn("in_main", F.col("class") == F.col("main")).withColumn("rows", deal(F.col("all") - F.col("most"))).withColumn("columns", deal(F.col("all")))
    place, upto = F.xxhash64("id"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("not in_main").select("band", F.pmod(place, "rows").alias("i"), upto("columns").alias("j"), F.lit(0).alias("side"), "id", "class", "in_main")
    every = rows.select("band", upto("rows").alias("i"), F.pmod(place, "columns").alias("j"), F.lit(1).alias("side"), "id", "class", "in_main")
    cell = F.xxhash64("band", F.col("i").cast("long"), F.col("j").cast("long")).alias("cell")
    return outer.select(cell, "side", "id", "class", "in_main").union(every.select(cell, "side", "id", "class", "in_main"))


class Held:
    """Weighted sets (id, class, hashes, weights), with which another is compared all at once: their shingles in order of hashes."""

    def __init__(self, outer: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        self.sets = outer
        self.ids, self.classes = (np.array([t[k] for t in outer], np.int64) for k in (0, 1))
        self.total = np.array([t[3].sum() for t in outer])
        hashes = np.concatenate([t[2] for t in outer])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.weights = hashes[order], np.concatenate([t[3] for t in outer])[order]
        self.owner = np.repeat(np.arange(len(outer)), [len(t[2]) for t in outer])[order]

    def alike(self, found: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
        """The numbers of the sets that are at least so similar."""
        low, high = np.searchsorted(self.hashes, found[0], "left"), np.searchsorted(self.hashes, found[0], "right")
        many = high - low
        at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
        both = np.bincount(self.owner[at], np.minimum(self.weights[at], np.repeat(found[1], many)), len(self.sets))
        near = np.flatnonzero(both >= (similarity - 1e-9) * (self.total + found[1].sum() - both))
        return np.array([k for k in near if weighted_jaccard(self.sets[k][2:], found) >= similarity], np.int64)  # the same sum as elsewhere


def _across(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of a bucket's texts that are of different classes and at least so similar. A cell's side 0 is held, side 1
    is read as a stream and compared with all that is held, without a sieve."""
    sent = _dealt(left).join(sets, "id").repartition("cell").sortWithinPartitions("cell", "side", "id", "digest")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, last, outer, held = None, None, [], None
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for here, side, i, group, main, hashes, levels_ in zip(*(c.to_pylist() for c in batch.columns)):
                if here != cell:
                    cell, last, outer, held = here, None, [], None
                if (side, i) == last:
                    continue  # a repeated row
                last = (side, i)
                found = np.frombuffer(hashes, np.uint32), weights(np.frombuffer(levels_, np.uint16))
                if side == 0:
                    outer.append((i, group, *found))
                elif outer:
                    held = held or Held(outer)
                    kept += [(int(held.ids[k]), i) for k in held.alike(found, similarity) if held.classes[k] != group and (main or held.ids[k] > i)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    return mapped(sent.select("cell", "side", "id", "class", "in_main", "hashes", "levels"), step, "a long, b long").distinct()


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that enough samples agree on, with how many do."""
    one, other = (texts.select(F.col("id").alias(x), F.col("sieve").alias(f"sieve_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(other, "b").withColumn("agree", _agreeing(F.col("sieve_a"), F.col("sieve_b")))
    return both.where(F.col("agree") >= AGREE).select("a", "b", "agree")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: Likeness = Likeness()) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for every row, with n_links: the number of different texts that its
    text was compared with and found alike."""
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)
    counted, documents = document_frequencies(docs)
    sketch = spark.sparkContext.broadcast(counted)
    signed = written(signatures(docs, sketch, documents), "near-signed")
    # One representative of each set of exact copies; a digest decides, so copies cost a row each and no comparison.
    copies = written(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sieve").alias("sieve")), "near-texts")
    texts = copies.select("id", "sieve")
    buckets = copies.select("id", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CROWD))
    members = written(buckets.join(shared.hint("merge"), "band").select("band", "id", "n", part.alias("part")), "near-members")

    # Shingles are made once, of all texts that share a bucket: the only ones that any round asks for.
    sets = written(_sets(docs, written(members.select("id").distinct(), "near-have"), sketch, documents), "near-sets")

    # The first round knows no classes: each text with its likeliest leader.
    likely = _likely(_stars(members), texts)
    chosen = written(likely.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b")), "near-pairs")
    links, tested = [written(_verified(chosen, sets, likeness.similarity), "near-links")], [chosen]
    grouped = components(links[0], "near")

    def with_classes(rows: DataFrame) -> DataFrame:
        known = grouped.withColumnRenamed("id", "known")
        return rows.join(known, rows.id == known.known, "left").withColumn("class", F.coalesce("class", "id")).drop("known")

    # Only buckets that hold several classes go on.
    placed = with_classes(members)
    mixed = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("band")
    left = written(placed.join(mixed, "band", "left_semi").select("band", "id", "n").join(texts, "id"), "near-left")
    turn, number = 0, links[0].count()
    while True:
        past = _together(tested).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        near_by = _near_by(with_classes(left), turn)
        chosen = written(near_by.join(past, (F.greatest("a", "b") == F.col("x")) & (F.least("a", "b") == F.col("y")), "left_anti"), "near-pairs")
        found = written(_verified(chosen, sets, likeness.similarity), "near-links")
        more = found.count()
        tested.append(chosen)
        links.append(found)
        turn, number = turn + 1, number + more
        if more <= likeness.settled * number:
            break
        before, grouped = grouped, written(_merged(grouped, found), "near-round")
        removed(before)
    removed(grouped)
    grouped = components(_together(links), "near")

    # What the rounds left out: all pairs of a bucket that still are of different classes.
    found = written(_across(with_classes(left), sets, likeness.similarity), "near-links")
    links.append(found)
    if not found.isEmpty():
        removed(grouped)
        grouped = components(_together(links), "near")

    numbers = grouped.withColumnRenamed("class", "class_id")
    ends = _together(links)
    degree = ends.union(ends.select("b", "a")).distinct().groupBy("a").agg(F.count("*").alias("n_links"))
    linked = numbers.join(degree, F.col("id") == F.col("a")).select(F.col("id").alias("node"), "class_id", "n_links")
    by_text = copies.select("digest", "id").join(linked, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    result = written(signed.where("digest is not null").select("doc_id", "digest").join(by_text, "digest").select("doc_id", "class_id", "n_links"), "near-classes")
    wordless = written(signed.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")), "near-classes")
    for t in (signed, copies, members, sets, left, grouped, *links, *tested):
        removed(t)
    return result.union(wordless)
