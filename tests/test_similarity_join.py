"""The similarity join against all pairs, and authority matches by hand."""

import random

import pytest
from pyspark.sql import functions as F

from catalogsmith.operators import join
from catalogsmith.plans.views import view


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b, rules):
    words, others = set(a.split(" ")), set(b.split(" "))
    if not a or not b:
        return False
    both = len(words & others)
    short = len(a) <= rules.short and len(b) <= rules.short
    return both >= rules.words * (len(words) + len(others) - both) - 1e-9 or short and 1 - distance(a, b) / max(len(a), len(b)) >= rules.edits - 1e-9


def edited(rng, title, edits):
    for _ in range(edits):
        at = rng.randrange(len(title) + 1)
        kind = rng.randrange(3)
        title = title[:at] + (rng.choice("abcxyz ") if kind else "") + title[at + (kind != 1) :]
    return title


@pytest.mark.parametrize("crowd, seed", [(1000, 1), (2, 2), (0, 3)])
def test_no_alike_pair_is_lost(spark, crowd, seed):
    rng = random.Random(seed)
    words = ["the", "of", "a", "study", "analysis"] * 3 + [f"{a}{b}" for a in ("hydro", "neuro", "geo", "bio") for b in ("logy", "graphy", "metry", "sis", "x")]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 8, 12]))) for _ in range(70)] + ["a", "ab", "abc", "abcdefghijklmnopqrst", "z" * 40, "z" * 41]
    titles = [edited(rng, t, rng.choice([0, 0, 1, 2, 4, 8])) for t in base for _ in range(6)] + ["", "   "]
    half = lambda k: [(f"{k}{i}", t, "", "", "") for i, t in enumerate(titles) if i % 2 == (k == "s")]
    r, s = half("r"), half("s")
    rules = join.DedupRules(crowd=crowd)
    schema = "id string, title string, author string, date string, doi string"
    found = [(p.r_id, p.s_id) for p in join.candidate_pairs(spark.createDataFrame(r + r[:20], schema), spark.createDataFrame(s, schema), rules).collect()]
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {(a[0], b[0]) for a in r for b in s if alike(fold(a[1]), fold(b[1]), rules)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 60


def test_dois_and_a_hot_title(spark):
    schema = "id string, title string, author string, date string, doi string"
    r = [(f"r{i}", "One title that many rows have", "Ana", "2001", "") for i in range(300)] + [("d1", "", "Ana", "2001", "10.1/X"), ("d2", "Other words", "", "", " 10.1/x ")]
    s = [("s1", "one title THAT many rows had", "Ana", "2001", ""), ("s2", "Quite different", "Ana", "2001", "10.1/X"), ("s3", "Other words", "Eva", "1999", "10.1/x")]
    found = {(e.id_document1, e.id_document2): e.similarity for e in join.duplicate_edges(spark.createDataFrame(r, schema), spark.createDataFrame(s, schema)).collect()}
    assert len(found) == 300 + 4 and {k for k in found if k[0][0] == "d"} == {("d1", "s2"), ("d1", "s3"), ("d2", "s2"), ("d2", "s3")}
    assert found["d1", "s2"] == 100 and found["d2", "s3"] == 100


def test_all_pairs_of_the_test_tables(spark, data):
    r, s = view(spark, data, "repository_records"), view(spark, data, "source_records")
    fold = join.folded(F.col("title")).alias("title")
    left, right = ([(x.id, x.title) for x in t.select("id", fold).collect()] for t in (r, s))
    rules = join.DedupRules()
    want = {(a[0], b[0]) for a in left for b in right if alike(a[1], b[1], rules)}
    assert {(p.r_id, p.s_id) for p in join.candidate_pairs(r, s).select("r_id", "s_id").collect()} == want


def test_authority(spark):
    authors = spark.createDataFrame([("a1", "Perez, Juan|||Perez, J."), ("a2", "Lopez, Ana"), ("a3", "Gomes, Ana|||Gomez, Anna"), ("a4", "Perez"), ("a5", None), ("a6", "")], "author_id string, variants string")
    docs = spark.createDataFrame([("1", "Pérez, Juan|Gomz, Ana"), ("2", "PEREZ, J.|Perez, Eva"), ("3", None), ("4", ""), ("5", "Ana Lopez"), ("6", "Peerz, Juan"), ("7", "Perezz, Juan|Nobody, Zoe")], "id string, author string")
    found = {r.id: [(c.pos, c.name, c.author_id, c.label) for c in r.coincidences] for r in join.authority(docs, authors).collect()}
    assert set(found) == set("1234567") and found["3"] == found["4"] == []
    assert found["1"][0] == (0, "Pérez, Juan", "a1", "PERFECT") and {c[2] for c in found["1"] if c[0] == 1} == {"a3"}
    assert found["2"][0][2:] == ("a1", "PERFECT") and not any(c[2] == "a1" for c in found["2"] if c[0] == 1)
    assert [c[2] for c in found["7"]] == ["a1"] and found["7"][0][3] == "GOOD"  # a letter too many
    assert found["6"] == []  # two letters the wrong way round are two edits
    assert [c[2] for c in found["5"]] == ["a2"]
    scopus = {r.id: [c.author_id for c in r.coincidences] for r in join.authority(spark.createDataFrame([("1", "Lopez Ana")], "id string, author string"), authors, mode="scopus").collect()}
    assert scopus == {"1": ["a2"]}


def test_scores_are_rounded_in_binary(spark, data):
    """halves that are such in decimal digits alone, and weights that make 1 in one order only, as the SQL has them."""
    import duckdb

    numbers = [i / 1000 + 1e-3 * j / 8 for i in range(0, 100_000, 7) for j in range(8)] + [1.005, 2.675, 57.345, 87.345, 0.5, 2.5]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    ours = df.select(join.rounded(F.col("x"), 4).alias("a"), join.rounded(F.col("x"), 2).alias("b"), F.round("x", 2).alias("c")).collect()
    con = duckdb.connect()
    con.execute("create table t as select unnest(?::double[]) as x", [numbers])
    theirs = con.execute("select round(x, 4), round(x, 2) from t").fetchall()
    assert [(r.a, r.b) for r in ours] == theirs
    assert any(r.c != r.b for r in ours)
    edge = join.duplicate_edges(*(spark.createDataFrame([(k, "same title here", "Ana", "2001", "")], "id string, title string, author string, date string, doi string") for k in "rs"))
    assert edge.first().similarity == 100.0


def test_rows_without_a_match_are_those_of_the_edges(spark, data):
    """the rows that no edge names, without the edges, at several thresholds; a title that most rows have costs no pair of rows."""
    rng = random.Random(5)
    schema = "id string, title string, author string, date string, doi string"
    words = ["the", "of", "a", "study", "analysis", "rocks", "birds", "cells", "stars"]
    titles = ["", "one title that many have"] + [" ".join(rng.choices(words, k=rng.choice([2, 4, 6]))) for _ in range(40)]

    def rows(k, n):
        return [(f"{k}{i}", rng.choice(titles), rng.choice(["Ana", "Eva Luz", "", "Anna"]), rng.choice(["2001", "2002", "2005", ""]), rng.choice(["", "", "", f"10.1/{rng.randrange(60)}"])) for i in range(n)]

    r, s = spark.createDataFrame(rows("r", 150), schema), spark.createDataFrame(rows("s", 200), schema)
    for rules in (join.DedupRules(), join.DedupRules(crowd=3)):
        edges = [(e.id_document2, e.similarity) for e in join.duplicate_edges(r, s, rules).collect()]
        for threshold in (60.0, 85.0, 100.0):
            bad = {i for i, x in edges if x >= threshold}
            assert sorted(x.id for x in join.unmatched(s, r, threshold, rules).collect()) == sorted({f"s{i}" for i in range(200)} - bad)
    many, other = (spark.range(30_000).select(F.concat(F.lit(k), "id").alias("id"), F.lit("one title that many have").alias("title"), F.col("id").cast("string").alias("author"), F.lit("2001").alias("date"), F.lit("").alias("doi")) for k in "rs")
    assert join.unmatched(other, many, 60.0).count() == 0


def test_authority_sends_surnames_once(spark):
    """signatures are numbers of distinct surnames, however many names and initials have them; strings are not multiplied."""
    names = spark.range(400).select(F.concat(F.lit("Perezolina, Given"), "id").alias("name"))
    surnames = names.select(F.lit("perezolina").alias("name_surname")).distinct()
    variants = spark.createDataFrame([("perezolin",), ("perezolinas",), ("perezotinas",)], "variant_surname string")
    near = join._near_surnames(surnames, variants)
    assert {r.variant_surname for r in near.collect()} == {"perezolin", "perezolinas"}
    assert dict(surnames.select(F.explode(join._deletions(F.col("name_surname"))).alias("x")).dtypes) == {"x": "bigint"}
    authors = spark.createDataFrame([("a", "Perezolin, G."), ("b", "Perezolinas"), ("c", "Perezolin, Eva")], "author_id string, variants string")
    found = join.matched_names(names, authors, least=0.0).groupBy("author_id").count().collect()
    assert {r.author_id: r["count"] for r in found} == {"a": 400, "b": 400}


def test_authority_broadcasts_no_exploded_rows(spark, data):
    """deletions of surnames, variants and names grow with the tables, so none goes through the driver, however small Spark takes it for."""
    documents, authors = view(spark, data, "authored"), view(spark, data, "authors")
    found = join.authority(documents, authors)
    assert found.where(F.size("coincidences") > 0).count() > 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "Broadcast" not in plan


def test_a_hot_title_is_spread_over_tasks(spark, monkeypatch):
    """rows of one title are made by many tasks, from lots of ids, each pair once; rows without an id or a year are among them."""
    schema = "id string, title string, author string, date string, doi string"
    for name, value in (("LOT", 32), ("TASK", 5_000)):
        monkeypatch.setattr(join, name, value, raising=False)
    years, people = ("2001", "2002", ""), ("Ana", "Eva Luz", "")

    def rows(k):
        return [(None if i == 7 else f"{k}{i}", "one title that most rows have", people[i % 7 % 3], years[i % 3], "") for i in range(250)] + [(f"{k}x", "something else altogether", "Ana", "2001", "")]

    r, s = spark.createDataFrame(rows("r"), schema), spark.createDataFrame(rows("s"), schema)
    edges = join.duplicate_edges(r, s).withColumn("part", F.spark_partition_id()).collect()
    pairs = [(e.id_document1, e.id_document2) for e in edges]
    assert len(pairs) == len(set(pairs)) == 250 * 250 + 1 and (None, None) in pairs
    most = max(sum(e.part == p for e in edges) for p in {e.part for e in edges})
    assert most < len(edges) / 4
    kinds = {x[0]: x[2:4] for x in rows("r") + rows("s")}
    scores = {}
    for e in edges:
        if e.id_document1 and e.id_document2:
            scores.setdefault((kinds[e.id_document1], kinds[e.id_document2]), set()).add(e.similarity)
    assert all(len(x) == 1 for x in scores.values()) and len(scores) == 81
    assert scores[("Ana", "2001"), ("Ana", "2001")] == scores[("", ""), ("Ana", "2002")] == {100.0} and scores[("Ana", "2001"), ("Ana", "2002")] == {95.0}
