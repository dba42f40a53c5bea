"""Near-duplicates against all pairs, and on odd tables."""

import random

import pytest

from catalogsmith.llm import near_duplicates


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def plain_links(texts, sketch, n, similarity=0.8):
    sets = [near_duplicates._weighted(t or "", sketch, n) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and near_duplicates.weighted_jaccard(sets[i], sets[j]) >= similarity]


def test_near_copies_of_all_kinds(spark, monkeypatch):
    """Pairs of all similarities, a group of near copies around one text that meets in one bucket's parts, and a shared passage."""
    monkeypatch.setattr(near_duplicates, "CROWD", 20)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, edits):
        words = words[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        return words

    texts = []
    for edits in range(1, 9):
        for _ in range(8):
            base = text(200)
            texts += [base, edited(base, edits)]
    base = text(150)
    texts += [edited(base, rng.randrange(1, 6)) for _ in range(160)]
    passage = text(60)
    texts += [passage + text(90) for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sketch, n = near_duplicates.document_frequencies(df)
    links = plain_links(texts, sketch, n)
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(df).collect()}
    true = components(len(texts), links)
    missed = [(a, b) for a, b in links if got[a] != got[b]]
    assert len(missed) <= 0.005 * len(links), (len(links), missed[:20])
    assert all(true[got[i]] == true[i] for i in got)  # nothing joined that all pairs leave apart


def test_odd_tables(spark):
    long = " ".join(f"x{i % 7001}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "one three"), (7, long), (8, long + " tail"), (None, "no id at all"), (9, "text a of id nine is here"), (9, "and a text b of nine")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, digest string, class string, `a b-c` int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in near_duplicates.classes(df).collect())
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 4, 0), (5, 4, 0), (6, 6, 0), (7, 7, 1), (8, 7, 1), (0, 0, 0), (9, 9, 0), (9, 9, 0)])
    assert near_duplicates.classes(df.where("false")).count() == 0


@pytest.mark.parametrize("least, most", [(0.8, 5e-4), (0.85, 1e-5)])
def test_sieves_lose_next_to_nothing(least, most):
    from math import comb

    bands = (1 - least**near_duplicates.ROWS) ** near_duplicates.BANDS
    p = least + (1 - least) / 16
    sieve = sum(comb(near_duplicates.SIEVE, k) * p**k * (1 - p) ** (near_duplicates.SIEVE - k) for k in range(near_duplicates.AGREE))
    assert bands < most and sieve < 1e-5


def test_no_pair_of_a_bucket_is_dropped(spark, monkeypatch):
    """with next to no reach and rounds that end at once, all links of crowded buckets are found nevertheless."""
    monkeypatch.setattr(near_duplicates, "CROWD", 15)
    monkeypatch.setattr(near_duplicates, "REACH", 1)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        words = base[:]
        for _ in range(rng.randrange(2, 6)):
            words[rng.randrange(150)] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sketch, n = near_duplicates.document_frequencies(df)
    links = plain_links(texts, sketch, n)
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(df, likeness=near_duplicates.Likeness(settled=1.0)).collect()}
    true = components(len(texts), links)
    assert len(links) > 20 and [(a, b) for a, b in links if got[a] != got[b]] == []
    assert all(true[got[i]] == true[i] for i in got)


def test_texts_of_a_crowded_bucket_are_sent_once_a_cell(spark, monkeypatch):
    """Near misses are no rows: a cell gets each text once, and its pairs are compared there; links are those of all pairs."""
    monkeypatch.setattr(near_duplicates, "CELL", 40)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(100):
        words = base[:]
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(150)] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketch, n = near_duplicates.document_frequencies(df)
    everyone = df.selectExpr("7L as band", "doc_id as id", "if(doc_id < 60, 0, doc_id) as class")
    sent = near_duplicates._dealt(everyone)
    # 100 texts in 3 columns and 1 row of cells: 40 outside the largest class go to each column, all to one row
    assert sent.count() == 40 * 3 + 100 and sent.groupBy("cell").count().agg({"count": "max"}).first()[0] < 100
    sets = near_duplicates._sets(df, df.selectExpr("doc_id as id"), spark.sparkContext.broadcast(sketch), n)
    found = {(max(r), min(r)) for r in near_duplicates._across(everyone, sets, 0.8).collect()}
    want = {(a, b) for a, b in plain_links(texts, sketch, n) if a >= 60}
    assert want and found == want
