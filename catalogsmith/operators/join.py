"""Joins of the catalog: duplicate detection, reconciliation, fills, replays and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_letters, least_year
from ..schema import col, cut_lineage, is_blank, is_empty_cell, ws_trim


@dataclass(frozen=True)
class DedupRules:
    """Weights of the parts of a score of 0 to 100; when two titles are alike: by the shares of their words that they have in
    common (Jaccard), or, of titles of up to short letters, by edits; how many pairs may share a signature before it is crowded;
    and the two thresholds of a decision."""

    title: float = 0.6
    author: float = 0.3
    date: float = 0.1
    words: float = 0.6
    edits: float = 0.9
    short: int = 40
    crowd: int = 1000
    review: float = 10.0
    duplicate: float = 30.0


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(ascii_letters(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the greater length; null if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / longest)


def year_likeness(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.abs(a - b) <= 1, 0.5).when(a.isNotNull() & b.isNotNull(), 0.0)


def rounded(c: Column, digits: int) -> Column:
    """Rounded in binary, half up: Spark's own round goes by the decimal digits that a double prints, so it turns some halves that
    are none in binary the other way."""
    return F.round(c * F.lit(float(10**digits))) / F.lit(float(10**digits))


#: Words of a signature at most. Titles that still crowd it are met by it nonetheless: it only leaves more pairs to check.
DEPTH = 5


def _word_pairs(left: DataFrame, right: DataFrame, rules: DedupRules) -> DataFrame:
    """(a, b): all pairs that can be alike by words, and few others. Of titles of n and m words, o at least are in both, so in the
    order of rarity the k-th of these is one of the first n - o + k words. A signature is the first shared word; where too many
    pairs have it, it goes on with the two sizes (these make o greater), and then with the second shared word, and so on."""
    share = rules.words / (1 + rules.words)
    both = left.select("tid", "title", F.lit(True).alias("l")).unionByName(right.select("tid", "title", F.lit(False).alias("l")))
    words = both.groupBy("tid").agg(F.first("title").alias("title"), F.collect_set("l").alias("sides")).select("tid", "sides", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(frequency, "word").groupBy("tid").agg(F.first("sides").alias("sides"), F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    ranked = ranked.select("tid", F.explode("sides").alias("l"), F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x["word"])).alias("w"))
    n, m = F.col("n"), F.col("m")
    rows = ranked.withColumn("last", F.explode(F.sequence(F.lit(0), n - F.ceil(F.lit(rules.words) * n - 1e-9).cast("int"))))
    rows = rows.select("tid", "l", "n", "w", F.lit(0).alias("m"), F.lit(0).alias("o"), "last", F.get("w", F.col("last")).alias("sig"))
    found, depth = [], 1
    while True:
        counts = rows.groupBy("sig").agg((F.count_if("l") * F.count_if(~F.col("l"))).alias("pairs")).where("pairs > 0")
        rows = cut_lineage(rows.join(counts, "sig"))
        full = (F.col("o") == depth) if depth < DEPTH else F.lit(True)
        done = rows.where((F.col("pairs") <= rules.crowd) | full)
        own = done.where("l").select("sig", F.col("tid").alias("a"), n.alias("na"))
        other = done.where("not l").select("sig", F.col("tid").alias("b"), n.alias("nb"))
        sized = (F.col("nb") >= rules.words * F.col("na") - 1e-9) & (F.col("na") >= rules.words * F.col("nb") - 1e-9)
        found.append(own.join(other, "sig").where(sized).select("a", "b"))
        rows = rows.where((F.col("pairs") > rules.crowd) & ~full).drop("pairs")
        if rows.isEmpty():
            return reduce(lambda x, y: x.union(y), found)
        if depth == 1 and len(found) == 1:
            rows = rows.withColumn("m", F.explode(F.sequence(F.ceil(F.lit(rules.words) * n - 1e-9).cast("int"), F.floor(n / rules.words + 1e-9).cast("int"))))
            rows = rows.withColumn("o", F.ceil(share * (n + m) - 1e-9).cast("int")).where("last <= n - o")
            sizes = F.when(F.col("l"), F.xxhash64("sig", "n", "m")).otherwise(F.xxhash64("sig", "m", "n"))
            rows = rows.withColumn("sig", sizes)
        else:
            depth += 1
            rows = rows.where(F.col("last") < n - F.col("o") + depth - 1).withColumn("last", F.explode(F.sequence(F.col("last") + 1, n - F.col("o") + depth - 1)))
            rows = rows.withColumn("sig", F.xxhash64("sig", F.get("w", F.col("last"))))


def _segments(n: Column, rules: DedupRules) -> tuple[Column, Column]:
    """For titles of n letters: how many edits may part them from one that is alike, and the numbers of that many segments and one
    more; one segment at least is the same in both."""
    most = F.floor(F.lit(1 - rules.edits) * F.floor(n / rules.edits + 1e-9) + 1e-9).cast("int")
    return most, F.sequence(F.lit(0), most)


def _segment(n: Column, most: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of segment i: of like length, the longer ones last."""
    base, longer = F.floor(n / (most + 1)).cast("int"), n % (most + 1)
    first_longer = most + 1 - longer
    return i * base + F.greatest(i - first_longer, F.lit(0)), base + (i >= first_longer).cast("int")


def _edit_pairs(left: DataFrame, right: DataFrame, rules: DedupRules) -> DataFrame:
    """(a, b) of short titles that share a segment of a at a place of b that the edits before and after it allow."""
    left, right = (t.where(F.length("title").between(1, rules.short)).withColumn("n", F.length("title")) for t in (left, right))
    most, numbers = _segments(F.col("n"), rules)
    cut = left.withColumn("most", most).withColumn("i", F.explode(numbers))
    start, size = _segment(F.col("n"), F.col("most"), F.col("i"))
    index = cut.select(F.xxhash64("n", "i", F.col("title").substr(start + 1, size)).alias("sig"), F.col("tid").alias("a"))
    lengths = F.sequence(F.ceil(rules.edits * F.col("own") - 1e-9).cast("int"), F.floor(F.col("own") / rules.edits + 1e-9).cast("int"))
    probes = right.withColumnRenamed("n", "own").withColumn("n", F.explode(lengths)).withColumn("most", most).withColumn("i", F.explode(numbers))
    delta = F.col("own") - F.col("n")
    low = F.greatest(-F.col("i"), delta - (F.col("most") - F.col("i")))
    high = F.least(F.col("i"), delta + (F.col("most") - F.col("i")))
    probes = probes.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("shift", F.explode(F.sequence("low", "high")))
    place = start + F.col("shift")
    probes = probes.where((place >= 0) & (place + size <= F.col("own")))
    return index.join(probes.select(F.xxhash64("n", "i", F.col("title").substr(place + 1, size)).alias("sig"), F.col("tid").alias("b")), "sig").select("a", "b")


def alike(a: Column, b: Column, rules: DedupRules = DedupRules()) -> Column:
    """Whether two folded titles are."""
    words, others = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both = F.size(F.array_intersect(words, others))
    by_words = both >= rules.words * (F.size(words) + F.size(others) - both) - 1e-9
    short = (F.length(a) <= rules.short) & (F.length(b) <= rules.short)
    return F.coalesce((a != "") & (b != "") & (by_words | (short & (likeness(a, b) >= rules.edits - 1e-9))), F.lit(False))


def alike_titles(left: DataFrame, right: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """All pairs of distinct titles (tid, title) of two tables that are alike: a, b and near, their likeness. Signatures are joined
    by numbers alone; titles are fetched for the pairs that share one, each pair once."""
    by_words = _word_pairs(left, right, rules)
    pairs = by_words.union(_edit_pairs(left, right, rules)).where("a != b").distinct()
    held = pairs.join(left.select(F.col("tid").alias("a"), F.col("title").alias("ta")), "a").join(right.select(F.col("tid").alias("b"), F.col("title").alias("tb")), "b")
    found = held.where(alike(F.col("ta"), F.col("tb"), rules)).select("a", "b", likeness(F.col("ta"), F.col("tb")).alias("near"))
    equal = left.join(right.select("tid"), "tid", "left_semi").select(F.col("tid").alias("a"), F.col("tid").alias("b"), F.lit(1.0).alias("near"))
    return found.union(equal)


def _sides(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """The distinct rows of a table without their titles, and its distinct titles by number. What is compared is kept, since the
    join reads it several times."""
    title, doi = folded(col("title")), F.when(~is_blank(col("doi")), F.lower(F.trim(col("doi"))))
    named = df.select(col("id").alias(f"{side}_id"), title.alias("title"), folded(col("author")).alias(f"{side}_author"), least_year(F.substring(col("date"), 1, 4)).alias(f"{side}_year"), doi.alias(f"{side}_doi"))
    named = cut_lineage(named.distinct().withColumn(f"{side}_tid", F.when(F.col("title") != "", F.xxhash64("title"))))
    rows = named.select(*(f"{side}_{c}" for c in ("id", "tid", "author", "year", "doi")))
    return rows, named.where("title != ''").select(F.col(f"{side}_tid").alias("tid"), "title").distinct()


#: Ids of a lot, about, and pairs of rows that a task makes of lots, about.
LOT, TASK = 512, 2_000_000
_KIND = ("tid", "author", "year")


def _lots(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Kinds: the rows of a title that have the same author and year, with their number and that of their lots; and the lots, to
    which ids are dealt by hash, so that no list grows with its kind."""
    kind = [f"{side}_{c}" for c in _KIND]
    rows = rows.where(F.col(f"{side}_tid").isNotNull())
    kinds = rows.groupBy(*kind).agg(F.count("*").alias(f"{side}_n")).withColumn(f"{side}_lots", F.ceil(F.col(f"{side}_n") / LOT).cast("int"))
    named = kinds.select(*(F.col(c).alias(f"k_{c}") for c in kind), f"{side}_lots")
    dealt = rows.join(named, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in kind)))
    lot = F.pmod(F.xxhash64(f"{side}_id"), F.col(f"{side}_lots")).cast("int").alias(f"{side}_lot")
    return kinds, dealt.groupBy(*kind, lot).agg(F.collect_list(F.struct(f"{side}_id")).alias(f"{side}_ids"))


def _expanded(near: DataFrame, r_rows: DataFrame, s_rows: DataFrame, made: Sequence[Column]) -> DataFrame:
    """r_id, s_id and made of all pairs of rows whose titles are in near. made is computed once for two kinds; then their lots meet by
    numbers, and the pairs of lots are dealt to tasks by how many rows they make, before any row is made, so that a title that
    most rows have is spread over all of them."""
    (r_kinds, r_lots), (s_kinds, s_lots) = _lots(r_rows, "r"), _lots(s_rows, "s")
    met = near.join(r_kinds, F.col("a") == F.col("r_tid")).join(s_kinds, F.col("b") == F.col("s_tid"))
    values = F.struct(*made).alias("made")
    met = cut_lineage(met.select(*(f"{x}_{c}" for x in "rs" for c in (*_KIND, "n", "lots")), values))
    total = met.agg(F.sum(F.col("r_n").cast("double") * F.col("s_n"))).first()[0] or 0
    pairs = met.drop("r_n", "s_n")
    for x, lots in (("r", r_lots), ("s", s_lots)):
        pairs = pairs.withColumn(f"{x}_lot", F.explode(F.sequence(F.lit(0), F.col(f"{x}_lots") - 1))).drop(f"{x}_lots")
        key = [f"{x}_{c}" for c in (*_KIND, "lot")]
        lots = lots.select(*(F.col(c).alias(f"l_{c}") for c in key), f"{x}_ids")
        pairs = pairs.join(lots, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in key))).drop(*lots.columns[:-1])
    spread = pairs.repartition(int(total // TASK) + 1, *(f"{x}_{c}" for x in "rs" for c in (*_KIND, "lot"))).select("r_ids", "s_ids", "made")
    return spread.select(F.inline("r_ids"), "s_ids", "made").select("r_id", F.inline("s_ids"), "made").select("r_id", "s_id", "made.*")


def candidate_pairs(repository: DataFrame, source: DataFrame, rules: DedupRules = DedupRules(), made: Sequence[Column] | None = None) -> DataFrame:
    """All pairs with alike titles or an equal DOI, once each: r_id, s_id and made, which is computed of r_author, r_year, the same of
    s, and near (the likeness of their titles, null if either has none), and is these if not given. Distinct titles are compared,
    and rows meet only in pairs that are in the result. Both sides need id, title, author, date, doi."""
    (r_rows, r_titles), (s_rows, s_titles) = _sides(repository, "r"), _sides(source, "s")
    made = made or [F.col(c) for c in ("r_author", "s_author", "r_year", "s_year", "near")]
    by_title = _expanded(alike_titles(r_titles, s_titles, rules), r_rows, s_rows, made)
    by_doi = r_rows.join(s_rows, F.col("r_doi") == F.col("s_doi"))
    by_doi = by_doi.join(r_titles.select(F.col("tid").alias("r_tid"), F.col("title").alias("ta")), "r_tid", "left").join(s_titles.select(F.col("tid").alias("s_tid"), F.col("title").alias("tb")), "s_tid", "left")
    only = by_doi.where(F.col("ta").isNull() | F.col("tb").isNull() | ~alike(F.col("ta"), F.col("tb"), rules)).withColumn("near", likeness(F.col("ta"), F.col("tb")))
    return by_title.union(only.select("r_id", "s_id", *made))


def _score(rules: DedupRules, near: Column, author: Column, date: Column) -> Column:
    """0 to 100. Parts that one side lacks carry no weight; weights are added in an order in which the usual ones make 0.7 and 1."""
    total = reduce(lambda a, b: a + b, (F.coalesce(w * x, F.lit(0.0)) for w, x in ((rules.title, near), (rules.author, author), (rules.date, date))))
    weight = reduce(lambda a, b: a + b, (F.when(x.isNotNull(), w).otherwise(0.0) for w, x in ((rules.title, near), (rules.date, date), (rules.author, author))))
    return rounded(F.when(weight > 0, 100 * total / weight).otherwise(0.0), 4)


def duplicate_edges(repository: DataFrame, source: DataFrame, rules: DedupRules = DedupRules(), digits: int | None = None) -> DataFrame:
    """id_document1 (repository), id_document2 (source) and similarity (0 to 100), rounded to four digits and then to so many as are
    asked. Parts that one side lacks carry no weight."""
    score = _score(rules, F.col("near"), likeness(F.col("r_author"), F.col("s_author")), year_likeness(F.col("r_year"), F.col("s_year")))
    score = score if digits is None else rounded(score, digits)
    return candidate_pairs(repository, source, rules, [score.alias("similarity")]).select(F.col("r_id").alias("id_document1"), F.col("s_id").alias("id_document2"), "similarity")


def unmatched(source: DataFrame, repository: DataFrame, threshold: float = 10.0, rules: DedupRules = DedupRules()) -> DataFrame:
    """without_duplicates(source, duplicate_edges(repository, source), threshold=threshold), without making the edges: rows that are
    alike in all that is compared are compared once, and not at all where their titles alone decide."""
    (r_rows, r_titles), (s_rows, s_titles) = _sides(repository, "r"), _sides(source, "s")
    r_kinds, s_kinds = (t.select(*(f"{x}_{c}" for c in ("tid", "author", "year", "doi"))).distinct() for x, t in (("r", r_rows), ("s", s_rows)))
    near = alike_titles(r_titles, s_titles, rules)
    whole = rules.title + rules.author + rules.date
    # The least score of a pair is that of authors and dates that differ, the greatest that of equal ones.
    near = near.withColumn("low", 100 * rules.title * F.col("near") / whole).withColumn("high", 100 * (rules.title * F.col("near") + rules.author + rules.date) / whole)
    near = cut_lineage(near.where(F.col("high") >= threshold - 1e-3))
    sure = near.where(F.col("low") >= threshold + 1e-3).select("b").union(near.where((F.col("near") == 1) & F.lit(100 * rules.title / whole >= threshold - 1e-9)).select("b")).distinct()
    open_ = near.join(sure, "b", "left_anti")
    scored = _score(rules, F.col("near"), likeness(F.col("r_author"), F.col("s_author")), year_likeness(F.col("r_year"), F.col("s_year")))
    known = ["s_tid", "s_author", "s_year", "s_doi"]
    plain = [c for c in known if c != "s_doi"]
    by_title = open_.join(r_kinds.select("r_tid", "r_author", "r_year").distinct(), F.col("a") == F.col("r_tid")).join(s_kinds.select(plain).distinct(), F.col("b") == F.col("s_tid"))
    by_title = by_title.where(scored >= threshold).select(plain).distinct()
    met = r_kinds.join(s_kinds, F.col("r_doi") == F.col("s_doi"))
    met = met.join(r_titles.select(F.col("tid").alias("r_tid"), F.col("title").alias("ta")), "r_tid", "left").join(s_titles.select(F.col("tid").alias("s_tid"), F.col("title").alias("tb")), "s_tid", "left")
    by_doi = met.withColumn("near", likeness(F.col("ta"), F.col("tb"))).where(scored >= threshold).select(known).distinct()

    def same(by: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (s_rows[c].eqNullSafe(by[c]) for c in by.columns))

    bad = s_rows.join(sure, F.col("s_tid") == F.col("b"), "left_semi").select("s_id")
    for by in (by_title, by_doi):
        bad = bad.union(s_rows.join(by, same(by), "left_semi").select("s_id"))
    return without_duplicates(source, bad.select(F.col("s_id").alias("id_document2"), F.lit(100.0).alias("similarity")), threshold=threshold)


def decision(score: Column, rules: DedupRules = DedupRules()) -> Column:
    """safe, review or duplicate."""
    return F.when(score < rules.review, "safe").when(score < rules.duplicate, "review").otherwise("duplicate")


def without_duplicates(source: DataFrame, edges: DataFrame, key: str = "id", threshold: float = 10.0) -> DataFrame:
    """Source rows that no edge at or over the threshold names; edges' ids are made distinct first."""
    bad = edges.where(F.col("similarity") >= threshold).select(ws_trim(F.col("id_document2").cast("string")).alias("__id")).distinct()
    return source.join(bad, ws_trim(col(key).cast("string")) == F.col("__id"), "left_anti")


def below_threshold(source: DataFrame, totals: DataFrame, key: str | None = "id", threshold: float = 10.0, position: str = "_row_id") -> DataFrame:
    """The older form: source rows whose id has a total below the threshold (not a number: 0). A table without a column total has it
    in its last column, one without id in its first. A source without a key is matched by position, a column that both have."""
    total = "total" if "total" in totals.columns else totals.columns[-1]
    if key is None:
        ident, own = position, position
    else:
        ident, own = "id" if "id" in totals.columns else totals.columns[0], key
    fine = totals.where(F.coalesce(col(total).try_cast("double"), F.lit(0.0)) < threshold).select(col(ident).cast("string").alias("__id")).distinct()
    return source.join(fine, col(own).cast("string") == F.col("__id"), "left_semi")


def fill_blank(df: DataFrame, lookup: DataFrame, key: str, fields: Sequence[str], also: dict[str, str] | None = None) -> DataFrame:
    """Blank cells take the lookup's value by key; also maps a field to a differently named source column to fill likewise.
    A key that the lookup has several times counts with its first row, so rows don't multiply."""
    order = F.col("_row_id") if "_row_id" in lookup.columns else F.struct(*(col(f) for f in fields))
    one = lookup.groupBy(col(key).cast("string").alias("__key")).agg(F.min_by(F.struct(*(col(f).cast("string").alias(f) for f in fields)), order).alias("g"))
    joined = df.join(one, col(key).cast("string") == F.col("__key"), "left")
    out = []
    targets = {f: f for f in fields if f in df.columns} | {c: f for f, c in (also or {}).items() if c in df.columns}
    for c in df.columns:
        value = F.col("g").getField(targets[c]) if c in targets else None
        out.append(F.when(is_empty_cell(col(c)) & ~is_empty_cell(value), value).otherwise(col(c)).alias(c) if value is not None else col(c))
    return joined.select(*out)


def replay(df: DataFrame, log: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Applies logged corrections (seq, row_id, column, cleaned): the last one of a cell wins. The log is pivoted to one row per
    record, so it is joined once."""
    last = [F.max_by("cleaned", F.when(F.col("column") == f, F.col("seq"))).alias(f"c_{f}") for f in fields]
    one = log.where(F.col("column").isin(*fields)).groupBy(F.col("row_id").alias("__key")).agg(*last)
    joined = df.join(one, col(key).cast("string") == F.col("__key").cast("string"), "left")
    return joined.select(*(F.coalesce(F.col(f"c_{c}"), col(c)).alias(c) if c in fields else col(c) for c in df.columns))


def lookup_join(df: DataFrame, key: str, provider: DataFrame, fields: Sequence[str], normalise=lambda c: c) -> DataFrame:
    """inferred_<field> from a provider table by a normalised key: distinct keys only are looked up. The provider is broadcast
    only if Spark knows it to be small."""
    keys = df.select(normalise(col(key)).alias("__k")).where("__k != ''").distinct()
    found = keys.join(provider.select(normalise(col(key)).alias("__k"), *(col(f).alias(f"inferred_{f}") for f in fields)), "__k")
    return df.withColumn("__k", normalise(col(key))).join(found, "__k", "left").drop("__k")


def sample_values(df: DataFrame, order: str, fields: Sequence[str], most: int = 5) -> DataFrame:
    """field, position (from 1) and value: of each field its first few different values that are not empty, in the order of a column.
    Values are aggregated before they are ranked, and a task keeps as many of a field as are asked."""
    entry = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), col(f).cast("string").alias("value")) for f in fields)))
    first = df.select(col(order).alias("at"), entry.alias("x")).where("x.value <> ''").groupBy("x.field", "x.value").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("field").orderBy("at", "value"))
    return first.withColumn("position", place).where(F.col("position") <= most).select("field", "position", "value")


def row_sync(source: DataFrame, generic: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Source columns (right) take the generic values (left) of the same row, by the surrogate and not by position."""
    own = generic.select("_row_id", *(col(g).alias(f"g_{g}") for g in fields))
    joined = source.join(own, "_row_id", "left")
    back = {s: g for g, s in fields.items()}
    return joined.select(*(F.coalesce(F.col(f"g_{back[c]}"), col(c)).alias(c) if c in back else col(c) for c in source.columns))


def merge_decisions(df: DataFrame, decisions: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Non-empty corrections by id; of several for one id and field the least, so that a rerun decides alike."""
    one = decisions.groupBy(col(key).alias("__key")).agg(*(F.min(F.nullif(col(f), F.lit(""))).alias(f"d_{f}") for f in fields))
    joined = df.join(one, col(key) == F.col("__key"), "left")
    return joined.select(*(F.coalesce(F.col(f"d_{c}"), col(c)).alias(c) if c in fields else col(c) for c in df.columns))


def exact_matches(source: DataFrame, repository: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Source rows that agree with a repository row on all columns of any of the keys: a semi-join per key, then a union."""
    found = [source.join(repository.select(*k).distinct(), list(k), "left_semi").where(reduce(lambda a, b: a & b, (~is_blank(col(c)) for c in k))) for k in keys]
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def _person(name: Column, mode: str) -> tuple[Column, Column, Column]:
    """Folded surname, initial of the given name, and both in that order. comma: "Surname, Given" ("Given Surname" without a comma);
    scopus: "Surname Given" or the same with a comma."""
    comma = F.instr(name, ",") > 0
    plain = folded(name)
    tail, head, rest = F.substring_index(plain, " ", -1), F.substring_index(plain, " ", 1), F.regexp_replace(plain, " ?[^ ]+$", "")
    before, after = folded(F.substring_index(name, ",", 1)), folded(F.substring_index(name, ",", -1))
    surname = F.when(comma, before).otherwise(head if mode == "scopus" else tail)
    given = F.when(comma, after).otherwise(F.substring(plain, F.length(head) + 2, F.length(plain)) if mode == "scopus" else rest)
    return surname, F.substring(given, 1, 1), F.trim(F.concat_ws(" ", surname, given))


def _deletions(surname: Column) -> Column:
    """Hashes of the surname and of all that it is without one letter: two surnames one edit apart have one of these in common."""
    each = F.transform(F.sequence(F.lit(1), F.length(surname)), lambda i: F.concat(F.substring(surname, F.lit(1), i - 1), F.substring(surname, i + 1, F.length(surname))))
    return F.transform(F.array_distinct(F.concat(F.array(surname), F.when(F.length(surname) > 0, each).otherwise(F.array()))), lambda x: F.xxhash64(x))


def _shuffled(df: DataFrame) -> DataFrame:
    """df, for a join by shuffle. Spark takes the size of rows that explode makes from the file they come from, so it would send
    tables through the driver, as broadcasts, that are many times what it expects."""
    return df.hint("merge")


def _near_surnames(one: DataFrame, other: DataFrame) -> DataFrame:
    """name_surname, variant_surname: all pairs of distinct surnames at most one edit apart. They meet by numbers, of the surname
    and of what it is without a letter."""
    mine, theirs = (t.select(f"{c}_surname", F.explode(_deletions(F.col(f"{c}_surname"))).alias("deleted")) for c, t in (("name", one), ("variant", other)))
    met = mine.join(_shuffled(theirs), "deleted").where(F.levenshtein("name_surname", "variant_surname") <= 1)
    return met.select("name_surname", "variant_surname").distinct()


def matched_names(names: DataFrame, authors: DataFrame, variants: str = "|||", least: float = 60.0, mode: str = "comma") -> DataFrame:
    """name, author_id, score and label for all distinct names whose surname is at most one edit from that of a variant, whose
    initial agrees (or is lacking on either side), with a score of least or more: the best variant of each author. Distinct surnames
    are compared first; only names and variants of those that are near are sent to meet."""

    def parted(df: DataFrame, c: str) -> DataFrame:
        surname, initial, whole = _person(F.col(c), mode)
        return df.select("*", surname.alias(f"{c}_surname"), initial.alias(f"{c}_initial"), whole.alias(f"{c}_whole")).where(F.col(f"{c}_surname") != "")

    known = authors.select("author_id", F.explode(F.split("variants", "\\Q" + variants + "\\E")).alias("variant")).where("trim(variant) != ''")
    mine, theirs = parted(names.select("name").where("trim(name) != ''").distinct(), "name"), parted(known, "variant").drop("variant").distinct()
    near = _near_surnames(mine.select("name_surname").distinct(), theirs.select("variant_surname").distinct())
    met = theirs.join(_shuffled(mine.join(_shuffled(near), "name_surname")), "variant_surname")
    either = (F.col("name_initial") == "") | (F.col("variant_initial") == "") | (F.col("name_initial") == F.col("variant_initial"))
    score = rounded(100 * likeness(F.col("name_whole"), F.col("variant_whole")), 4)
    best = met.where(either).groupBy("name", "author_id").agg(F.max(score).alias("score")).where(F.col("score") >= least)
    label = F.when(F.col("score") >= 100, "PERFECT").when(F.col("score") >= 90, "GOOD").when(F.col("score") >= 75, "REGULAR").otherwise("MMM")
    return best.withColumn("label", label)


def authority(documents: DataFrame, authors: DataFrame, variants: str = "|||", least: float = 60.0, mode: str = "comma") -> DataFrame:
    """A row for each document (id, author: names apart by bars): id and coincidences, the matches of its names in their order, best
    first, as structs of pos, name, author_id, score and label. Names are compared once each, however many documents have them."""
    names = documents.select("id", F.posexplode(F.split(F.coalesce("author", F.lit("")), r"\|")).alias("pos", "name"))
    found = matched_names(names, authors, variants, least, mode)
    held = names.join(_shuffled(found.withColumnRenamed("name", "known")), F.col("name") == F.col("known"), "left")
    entry = F.struct("pos", (-F.col("score")).alias("by"), "author_id", "name", "score", "label")
    lists = held.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("author_id").isNotNull(), entry))).alias("found"))
    return lists.select("id", F.transform("found", lambda x: F.struct(x["pos"].alias("pos"), x["name"].alias("name"), x["author_id"].alias("author_id"), x["score"].alias("score"), x["label"].alias("label"))).alias("coincidences"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*(col(k) for k in keys)).orderBy(*(col(o) for o in order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
