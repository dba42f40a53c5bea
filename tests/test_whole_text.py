"""Texts longer than any bound that the rules once had."""

import random
import re
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from catalogsmith.functions import text as t
from catalogsmith.plans.record_queries import QUERIES

UNIT = "a passage that comes again; "


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_first_cycle_is_that_of_the_pattern():
    rng = random.Random(1)
    for k in range(600):
        letters = ["ab", "abc\n", "abcdefghij \n"][k % 3]
        text = "".join("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 7, 14, 15, 16, 17, 33, 40]))) * rng.choice([1, 1, 2, 3, 6, 16]) for _ in range(4))
        for lines, pattern in ((False, r"(?s)(.{15,}?)\1{2}"), (True, r"(.{15,}?)\1{2}")):
            m = re.search(pattern, text)
            assert t.first_cycle(text, lines) == (m and (m.start(1), len(m[1])))


def test_cycles_of_long_texts(spark):
    lead = words(random.Random(2), 2000)
    assert len(lead) > 4000
    rows = spark.createDataFrame([(0, lead + " " + UNIT * 3 + "tail"), (1, lead), (2, None), (3, "x" * 10_000)], "i int, v string")
    got = rows.select("i", t.cyclic(F.col("v")).alias("on"), t.cut_cycle(F.col("v")).alias("cut")).orderBy("i").collect()
    assert [r.on for r in got] == [True, False, False, True]
    assert [r.cut for r in got] == [lead + " " + UNIT[:-2], lead, None, "x" * 15]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 documents of about 300 characters, but 13 is very long and 19 has a cycle after character 3000."""
    rng = random.Random(4)
    texts = [words(rng, 55) for _ in range(40)]
    texts[13], texts[19] = words(rng, 3600), words(rng, 600) + " " + UNIT * 3 + "tail"
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert len(texts[13]) > 15_000 and texts[19].index(UNIT) > 3000
    return path, texts


def test_queries_read_whole_texts(spark, folder):
    path, texts = folder
    run = lambda name: QUERIES[name](spark, path).collect()
    sizes = [len(x) for x in texts]
    outliers = {i for i, n in enumerate(sizes) if n >= 200 and (n - mean(sizes)) / stdev(sizes) > 3}
    assert outliers == {13} == {r.row_id for r in run("k10_length_outlier") if r.value}
    stats = run("g1_length_stats")[0]
    assert abs(stats.mean_description - mean(sizes)) < 1e-3 and abs(stats.sd_description - stdev(sizes)) < 1e-3
    assert {r.row_id for r in run("k7_cyclic") if r.value} == {19}
    cut = texts[19][: texts[19].index(UNIT) + len(UNIT)].rstrip("–,; ")
    for name, field in (("k15_cut_cycle", "value"), ("k18_dispatch", "description")):
        assert {r.row_id: r[field] for r in run(name)} == {i: cut if i == 19 else x for i, x in enumerate(texts)}
    # 13, 19 and 26 have no anomaly but in their descriptions
    found = {r.row_id: (r.anomalies, r.score) for r in run("k12_row_analysis")}
    assert found[13] == ('{"description":["LONGITUD_ANOMALA"]}', 0.35) and found[19] == ('{"description":["REPETICION_CICLICA"]}', 0.8) and found[26] == ("{}", 0.0)
    label = {r.row_id: r.triage for r in run("e3_triage")}
    assert label[13] == label[19] == "suspicious" and label[26] == "clean"
    review = {r.row_id for r in run("m12_curation")}
    assert 13 in review and not {19, 26} & review


def test_cycles_of_texts_searched_together():
    rng = random.Random(11)
    texts = ["", "ab" * 40, "x" * 44, "x" * 45, "a line\n" * 20]
    for _ in range(300):
        part = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        texts.append("".join(rng.choice(["", part, part * 2, part * 3, "abcab", "\n"]) for _ in range(rng.randint(0, 6))))
    for lines, dot in ((True, "[^\\n\\r\\u0085\\u2028\\u2029]"), (False, "(?s:.)")):
        alone = [t.first_cycle(x, lines) for x in texts]
        assert t.first_cycles(texts, lines) == alone
        assert [x is not None for x in alone] == [re.search(rf"({dot}{{15,}}?)\1\1", x) is not None for x in texts]
