"""Training samples on lopsided tables, distances of quality rules, and the pipeline's stages, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogsmith.llm import ann, language_id, near_duplicates, quality_classifier, quality_rules, sampling, toxicity


def test_a_repeated_row_empties_no_sample(spark):
    rows = [(i, f"text number {i}", i % 2) for i in range(300)]
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(rows[7][1]).alias("text"))
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(7, 0)], "doc_id long, label int")
    args = ("doc_id", "text", "label", {0: 1000, 1: 1000}, 100)
    want = sampling.labelled_texts(plain, labels, *args)
    assert len(want) == 300 and all(sampling.labelled_texts(plain.union(hot).repartition(n), labels, *args) == want for n in (3, 8))


def test_all_languages_are_learned(spark):
    rows = [(f"{i}-{k}", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (k + j) % 26)}" for j in range(8)), f"l{i:02d}") for i in range(45) for k in range(6)]
    plain = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    hot = spark.range(20_000).select(F.lit(rows[0][0]).alias("doc_id"), F.lit(rows[0][1]).alias("text"), F.lit(rows[0][2]).alias("lang"))
    want = language_id.labelled_sample(plain, F.col("lang"), "text", "doc_id", language_id.Sample())
    assert len(set(want[1])) == 45 and len(want[0]) == len(rows)
    assert all(language_id.labelled_sample(plain.union(hot).repartition(n), F.col("lang"), "text", "doc_id", language_id.Sample()) == want for n in (3, 8))
    model = language_id.fit(*want)
    assert len(model.languages) == 45
    found = {r.lang_pred for r in language_id.identify(plain.withColumn("doc_id", F.xxhash64("doc_id")), model).collect()}
    assert len(found) > 40


def test_many_languages_share_a_model_of_one_size(monkeypatch):
    monkeypatch.setattr(language_id, "WEIGHTS_BITS", 14)
    words = [[f"{a}{b}" for b in ("ola", "est", "ung", "ique")] for a in "bdfgklmp"]
    texts = [" ".join(random.Random(i).choices(words[i % 8], k=12)) for i in range(160)]
    model = language_id.fit(texts, [f"l{i % 8}" for i in range(160)])
    assert model.weights.shape == (1 << 11, 8)
    assert language_id.word_languages(model, "bola best bung")[0][1] == "l0"


def test_a_repeated_vector_takes_one_rank(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows[0], near = (0, [1.0] * 8), [1.0] * 7 + [1.1]
    for i in (10, 11, 12, 13, 14):
        rows[i] = (i, near)
    df = spark.createDataFrame(rows + [rows[10]] * 10 + [(10, [1.0] * 8)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["rank"], r.vec_id) for r in ann.nearest(df).where("query_id = 0").collect())
    assert got == list(enumerate([10, 11, 12, 13, 14], 1))


def _histograms(text):
    """The two histograms of the quality rules, letter by letter."""
    slab = quality_rules.Slab([text])
    return [quality_rules._shares(h)[0] for h in quality_rules._histograms(slab, *slab.words())]


def _distance(p, q):
    half = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, half) if a > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_distances_and_verdicts_of_quality_rules(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    made = {}
    for _, text, lang in rows:
        if lang in quality_rules.LANGUAGES and text.split():
            made.setdefault(lang, []).append(_histograms(text))
    mean = {k: [np.mean([h[i] for h in v], axis=0) for i in (0, 1)] for k, v in made.items()}
    rules = quality_rules.Rules()
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    seen = set()
    for doc_id, text, _ in rows:
        r = got[doc_id]
        if not r.n_words:
            assert (r.js_chars, r.js_words, r.kept) == (0, 0, False)
            continue
        chars, words = _histograms(text)
        found = {k: (_distance(chars, m[0]), _distance(words, m[1])) for k, m in mean.items()}
        best = found[r.nearest_lang]
        assert sum(best) <= min(map(sum, found.values())) + 1e-9
        assert abs(best[0] - r.js_chars) < 1e-6 and abs(best[1] - r.js_words) < 1e-6
        far = best[0] > rules.max_chars and r.n_words >= rules.min_words_chars or best[1] > rules.max_words and r.n_words >= rules.min_words_words
        assert r.kept == (not r.base_failed and not far)
        seen.add((r.base_failed, bool(far)))
    assert len(seen) >= 3
    odd = spark.createDataFrame([(1, " ".join(["zzqx#"] * 30 + [str(i) for i in range(29)])), (2, " ".join(str(i) for i in range(19))), (3, None)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert [r.kept for r in quality_rules.judge(odd, references={k: tuple(v) for k, v in mean.items()}).orderBy("doc_id").collect()] == [False, False, False]


def test_other_scripts_look_different():
    words = ["привет", "собака", "κόσμος", "世界", "שלום"]
    slab = toxicity.Slab([" ".join(words), "𝓲𝓭𝓲𝓸𝓽 idiot"], apart=True)
    stream, first, sizes, owner = toxicity.read_words(slab)
    found = [tuple(stream[a : a + n]) for a, n in zip(first, sizes)]
    assert len(set(found[:5])) == 5 and found[5] == found[6] and list(owner) == [0] * 5 + [1] * 2


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_against_plain_versions(spark, data, pipeline):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    model = quality_classifier.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    judged = quality_classifier.judged(docs, model).select("row.doc_id", "quality_kept")
    good = pipeline.written(pipeline.quality(spark, docs, data), "test-quality")
    assert ids(good) == ids(judged.where("quality_kept"))
    model = language_id.train(good)
    plain = []
    for r in good.collect():
        slab = language_id.Slab([r.text], apart=True)
        words = language_id.Words(slab)
        if len(words):
            found, _ = language_id.forward_backward(words.scores(model.weights), language_id.chains_of(slab, words), model.transitions)
            if found.mean(0).max() >= pipeline.LEAST_LANGUAGE:
                plain.append(r.doc_id)
    told = pipeline.written(pipeline.language(spark, good, data), "test-language")
    assert ids(told) == sorted(plain)
    rows = [(r.doc_id, r.text) for r in told.select("doc_id", "text").collect()]
    sketch, n = near_duplicates.document_frequencies(told)
    sets = {i: near_duplicates._weighted(t, sketch, n) for i, t in rows}
    least = {i: i for i, _ in rows}
    texts = dict(rows)
    def top(i):  # noqa: E306
        while least[i] != i:
            i = least[i]
        return i
    for i, _ in rows:
        for j, _ in rows:
            if j < i and (texts[i] == texts[j] or near_duplicates.weighted_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((top(i), top(j)))
                least[b] = a
    assert ids(pipeline.deduplicate(spark, told, data)) == sorted(i for i in least if top(i) == i)


def test_texts_meet_the_dropped_ids_only(spark, pipeline, monkeypatch):
    """The ids that go, not those that stay, are joined to the texts, and once if no id has several rows."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 3, 0)], "doc_id long, class_id long, n_links long")
    monkeypatch.setattr(pipeline.near_duplicates, "classes", lambda df: found)
    kept = pipeline.deduplicate(spark, docs, "")
    assert sorted(r.text for r in kept.collect()) == ["a", "c", "d"]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "Join LeftSemi" not in plan


def test_stages_on_odd_tables(spark, data, pipeline):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row string, p string"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("*", F.lit("x").alias("a.b"), F.lit("y").alias("row"), F.lit("z").alias("p"))
    odd = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, None, None, None, None, "", "", ""), (1, "", "", "", 0, "", "", "")], schema))
    for table, least in ((odd, 50), (docs.where("false"), 0)):
        for _, stage in pipeline.STAGES[:-1]:
            table = pipeline.written(stage(spark, table, data), "test-odd")
            assert table.columns == docs.columns and table.count() >= least
