"""Relevance by hand, and trees against walks in plain Python."""

import math
import random
import re

import pytest

from catalogsmith.operators import text_index, tree


def test_relevance_by_hand(spark, tmp_path):
    rng = random.Random(2)
    words = ["Árbol", "casa", "the", "of", "rare", "x9"]
    texts = {i: " ".join(rng.choices(words, [3, 3, 8, 8, 1, 1], k=rng.randrange(30))) for i in range(60)} | {90: None, 91: "", 92: "--- !"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    held = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in texts.items()}
    mean = sum(map(len, held.values())) / len(held)

    def plain(query):
        out = {}
        for term in set(re.split(r"[\W_]+", query.lower())) - {""}:
            df_ = sum(term in w for w in held.values())
            for i, w in held.items():
                if tf := w.count(term):
                    out[i] = out.get(i, 0) + math.log(1 + (len(held) - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return out

    index = text_index.build(df, "id", ["text"])
    index.write(str(tmp_path / "index"))
    stored = text_index.TextIndex.read(spark, str(tmp_path / "index"))
    for query in ("rare árbol, rare", "the x9 nowhere", "", "nothing"):
        want = plain(query)
        for i in (index, stored):
            got = {r.key: r.score for r in text_index.ask(i, query).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = [r.key for r in text_index.best(text_index.ask(stored, "rare x9"), 3).collect()]
    want = plain("rare x9")
    assert best == sorted(want, key=lambda k: (-round(want[k], 12), k))[:3]
    read = text_index.ask(stored, "rare")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and "bucket" in read.split("PartitionFilters:")[1][:60]


def test_scores_are_summed_where_the_rows_lie(spark, tmp_path):
    """of many queries' scores, rows are dealt by key once and never by term or by query and key; repeated rows are one text."""
    texts = [(1, "red fox fox"), (1, "red fox fox"), (2, "the red hen"), (3, None), (4, "a hen and a fox")]
    spark.createDataFrame([(7, "Fox, hen fox"), (8, "red"), (9, "nothing")], "query int, text string").write.parquet(str(tmp_path / "queries"))
    queries = spark.read.parquet(str(tmp_path / "queries"))  # a stored table: its size is known to be small
    scored = text_index.scores(text_index.build(spark.createDataFrame(texts, "id long, text string"), "id", ["text"]), queries)
    got = {(r.query, r.key): r.score for r in scored.collect()}
    # five rows of 3, 3, 3, 0 and 5 tokens; fox and red are in two keys each, hen in two
    part = lambda tf, n: math.log(1 + 3.5 / 2.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2.8))
    want = {(7, 1): part(4, 3), (7, 2): part(1, 3), (7, 4): part(1, 5) + part(1, 5), (8, 1): part(2, 3), (8, 2): part(1, 3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = text_index.best(scored, 5, ["query"])._jdf.queryExecution().executedPlan().toString()
    dealt = {tuple(re.findall(r"(\w+)#", d)) for d in re.findall(r"hashpartitioning\(([^)]*)\)", plan)}
    assert ("key",) in dealt and not {("query", "key"), ("term", "key")} & dealt, dealt


def _nodes():
    rng = random.Random(5)
    rows = [(0, None)] + [(i, rng.randrange(max(0, i - 4), i)) for i in range(1, 150)]  # deep
    rows += [(300, 301), (301, 302), (302, 300), (303, 302), (310, 310), (320, 999), (321, 320), (None, 4)]
    return rows


def _walk(rows):
    up, out = {i: p for i, p in rows if i is not None}, {}
    for i in up:
        path, at = [], i
        while at in up and at not in path:
            path.append(at)
            at = up[at]
        out[i] = None if at in path else path[::-1]
    return out


def test_paths_and_subtrees(spark):
    rows = _nodes()
    nodes = spark.createDataFrame([(*r, "x") for r in rows], "id long, parent long, way string").repartition(3)
    want = _walk(rows)
    got = {r.id: r for r in tree.paths(nodes, "id", "parent").collect()}
    assert {i: r.path for i, r in got.items()} == want and all(r.cyclic == (r.path is None) and (r.path is None or r.depth == len(r.path) - 1) for r in got.values())
    assert {r.id for r in tree.subtree(nodes, "id", "parent", 20).collect()} == {i for i, p in want.items() if p and 20 in p}
    sizes = {r.id: r.nodes for r in tree.subtree_sizes(nodes, "id", "parent").collect()}
    assert sizes == {i: sum(i in p for p in want.values() if p) for i in want if want[i]}
    assert tree.paths(nodes.where("false"), "id", "parent").count() == 0


def test_changes_keep_a_tree(spark):
    nodes = spark.createDataFrame([(*r, f"n{r[0]}") for r in _nodes() if r[0] is not None], "id long, parent long, name string")
    moved = tree.move(nodes, "id", "parent", 20, 2)
    assert {r.id: r.path for r in tree.paths(moved, "id", "parent").collect()} == _walk([(i, 2 if i == 20 else p) for i, p in _nodes() if i is not None])
    below = max(i for i, p in _walk(_nodes()[:150]).items() if 20 in p)
    for node, to in ((20, below), (20, 20), (20, 300), (20, 5555), (5555, 1)):
        with pytest.raises(ValueError):
            tree.move(nodes, "id", "parent", node, to)
    assert tree.move(nodes, "id", "parent", 20, None).where("id = 20 and parent is null").count() == 1
    new = spark.createDataFrame([(700, 20, "a"), (701, 700, "b")], nodes.schema)
    assert tree.create(nodes, "id", "parent", new).count() == nodes.count() + 2
    for bad in ([(20, None, "again")], [(700, 9999, "nowhere")], [(700, 1, "a"), (700, 1, "b")]):
        with pytest.raises(ValueError):
            tree.create(nodes, "id", "parent", spark.createDataFrame(bad, nodes.schema))
    changed = tree.update(nodes, "id", spark.createDataFrame([(20, 1, "new"), (21, 1, None), (8888, 1, "z")], nodes.schema), fixed=("parent",))
    names = {r.id: (r.parent, r.name) for r in changed.collect()}
    assert names[20][1] == "new" and names[21][1] == "n21" and {i: p for i, (p, _) in names.items()} == dict(r for r in _nodes() if r[0] is not None)
