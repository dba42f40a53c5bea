"""Near-duplicates, nearest neighbours, chat windows and the pipeline against plain versions."""

import random

import duckdb
import numpy as np
import pytest

from catalogsmith.llm import ann, chat, near_duplicates, queries


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(12)]
    texts = []
    for b in base:
        words = b.split()
        texts += [b, b]
        for _ in range(4):
            copy = words[:]
            copy[rng.randrange(200)] = "edited"
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(25)]
    texts += [None, "", "short text", "short text", "short one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sketch, n = near_duplicates.document_frequencies(df)
    sets = [near_duplicates._weighted(t or "", sketch, n) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_duplicates.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert near_duplicates.classes(df.where("false")).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    words = [f"v{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:300] + [f"u{i}" for i in range(100)])
    slab = near_duplicates.Slab([a, b])
    of, found, count = near_duplicates.shingles(slab)
    got = near_duplicates.samples(of, found, np.full(len(found), 8), 2, 0, 400)
    plain = len(set(found[of == 0]) & set(found[of == 1])) / len(set(found))
    assert abs((got[0] == got[1]).mean() - plain) < 0.08


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]  # copies, a query among them
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, 2.0]), (7, x[7].tolist())]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(1500), -s.round(12))) if i != q][:5]
        hits += len({v for v, _ in got[q].values()} & set(order))
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for v, c in got[q].values())
    assert set(got) == set(range(0, 1500, 50)) and hits >= 0.9 * 150
    assert [v for _, (v, _) in sorted(got[100].items())] == [101, 102, 103, 104, 105]
    assert ann.nearest(df.where("vec_id in (50, 3)")).count() == 1 and ann.nearest(df.where("false")).count() == 0


CHAT = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_start|> \\s there"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user"), (2, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
    (3, 0, "system", "s"), *((3, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (40 * (i % 5))) for i in range(1, 60)), (3, 60, "assistant", "long " * 3000), (None, 0, "us\ner", "no conversation"),
]


def test_chat(spark):
    df = spark.createDataFrame([(*c, "x") for c in CHAT], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(chat.with_planted(df))
    con = duckdb.connect()
    conversations = df.drop("window").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  (DuckDB finds it by name)
    result = con.execute(chat.ORACLE)
    names = [d[0] for d in result.description]
    plain = {r[0]: r for r in result.fetchall()}
    for r in chat.digests(windows).collect():
        assert tuple(r[c] for c in names) == plain[r.conv_id]
    for w in windows.where("conv_id = 3").collect():
        assert w.formatted.startswith("<|im_start|>system\ns<|im_end|>\n")
        turns = w.formatted.count("<|im_start|>")
        assert turns == w.n_turns and (len(w.formatted) < 6 * 2048 or turns - w.context_turns == 1)
    assert chat.digests(chat.format_windows(df.where("false"))).count() == 0


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, data), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0.5 * before < docs.count() <= before
    good = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    texts = {r.text for r in good.select("text").collect()}
    assert docs.join(good.select("doc_id"), "doc_id").count() >= 0.85 * len(texts)
    packed = pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.ORACLES) <= set(queries.QUERIES)
