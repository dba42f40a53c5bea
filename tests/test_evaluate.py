"""Scores of evaluation cases, by hand."""

import pytest
from pyspark.sql import functions as F

from catalogsmith.operators import evaluate as ev

C = F.col


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        (0, [("Name", "title", True), ("By", "author[es]", False), ("Name", "title", False)]),
        (1, []),
        (2, [("Year", "date", True), (None, None, None)]),
    ]
    return spark.createDataFrame(rows, "i int, m array<struct<left:string,replace:string,required:boolean>>")


def values(df, c):
    return [r.v for r in df.select("i", c.alias("v")).orderBy("i").collect()]


def names(*x):
    return F.array(*map(F.lit, x)).cast(ev.NAMES)


def pairs(*x):
    return F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("replace")) for a, b in x)).cast(ev.PAIRS)


def test_mappings(cases):
    m = C("m")
    assert values(cases, ev.pairs_kept(m, pairs(("By", "author"), ("Year", "date")))) == [0.5, 0, 0.5]
    assert values(cases, ev.pairs_kept(m, F.lit(None).cast(ev.PAIRS))) == [None] * 3
    assert values(cases, ev.targets_covered(m, names("title", "date"))) == [0.5, 0, 0.5]
    assert values(cases, ev.pairs_avoided(m, pairs(("By", "author")), names("Year"))) == [1, 1, 0]
    assert values(cases, ev.configuration_repaired(m, pairs(("By", "author")), names("Year"), pairs())) == [1, 0, 0]
    assert values(cases, ev.configuration_repaired(m, pairs(), names(), pairs(("By", "author[es]")))) == [None] * 3
    assert values(cases, ev.feedback_recovered(m, names("title"), pairs(("NAME", "title")), names("year"), names("date"), names("title"))) == [1, 0, 0]
    assert values(cases, ev.feedback_recovered(m, names(), pairs(), names("NAME"), names(), names())) == [0, 1, 1]
    assert values(cases, ev.feedback_recovered(m, names(), pairs(), names(), names(), names("date"))) == [1, 1, 0]
    assert values(cases, ev.feedback_recovered(m, *[names()], pairs(), names(), names(), names())) == [None] * 3


def test_patterns(spark):
    sample = [("June 2011", "2011"), ("none", "")]
    rows = [(0, r"(\d{4})", sample), (1, r"\d{4}", sample), (2, "(", sample), (3, None, sample), (4, r"(\d)", []), (5, r"(\w)|x", [("x", "x")])]
    df = spark.createDataFrame(rows, "i int, p string, s array<struct<value:string,expected:string>>")
    assert values(df, ev.extraction_exact(C("p"), C("s"))) == [1, 1, 0.5, 0.5, None, 1]
    rows = [
        (0, r"\|", ["A. B.|C", "D|E"], [["A. B", "C"], ["D", "E"]], 0.9, False),
        (1, r"\.", ["A. B.|C", "D|E"], [["A. B", "C"], ["D", "E"]], 0.9, False),
        (2, r"\|", ["A|B", "C"], None, 0.9, False),
        (3, r"\|", ["A|B", "C"], None, 0.5, False),
        (4, "SIN_PATRON", ["A|B"], None, 0.5, True),
        (5, r"\|", ["A|B"], None, 0.5, True),
        (6, "(", ["A"], None, 0.5, True),
        (7, " ", ["A"], None, 0.5, False),
        (8, r"\|", [], None, 0.5, False),
    ]
    df = spark.createDataFrame(rows, "i int, p string, s array<string>, t array<array<string>>, least double, quiet boolean")
    got = values(df, ev.splitting_exact(C("p"), C("s"), C("t"), C("least"), C("quiet")))
    assert got == [1, 0, 0.5, 1, 1, 0, 0, 0, None]


def test_decisions(spark):
    df = spark.createDataFrame([(0, {"June": "06"}, "ok", 2, True, {"a": "x"}, "fixed "), (1, {}, "ok", 0, True, {}, " "), (2, None, None, None, None, None, None)],
                               "i int, r map<string,string>, status string, n int, valid boolean, c map<string,string>, notes string")
    assert values(df, ev.rules_named(C("r"), names("JUNE", "july"), names("06"))) == [1, 0, 0]
    assert values(df, ev.rules_named(C("r"), names(), names())) == [None] * 3
    allowed = F.array(F.struct(F.lit("a").alias("id"), names("x", "y").alias("values")))
    assert values(df, ev.repair_done(F.lit(True), C("status"), C("n"), C("valid"), C("c"), allowed)) == [1, 0, 0]
    assert values(df, ev.repair_done(F.lit(False), C("status"), C("n"), C("valid"), C("c"), allowed)) == [None] * 3
    assert values(df, ev.has_notes(C("notes"))) == [1, 0, 0]
    for mode, good, bad in (("relevant", "transferred", "not_transferred"), ("mixed", "told_apart", "confused")):
        assert values(df, ev.memory_effect(F.lit(mode), F.lit(True), C("i") == 0, F.lit(None).cast("boolean"))) == [good, bad, bad]
    assert values(df, ev.memory_effect(F.lit("distractor"), F.lit(True), F.lit(False), C("i") == 0)) == ["contaminated", "ignored", "ignored"]
    assert values(df, ev.memory_effect(F.lit("none"), F.lit(True), F.lit(True), F.lit(False))) == [None] * 3
    assert values(df, ev.action_right(C("i") == 0, C("i") == 1, C("i") == 0, C("i") == 1)) == [1, 1, 0]
    rows = ev.summary(df, {"notes": ev.has_notes(C("notes")), "rules": ev.rules_named(C("r"), names(), names())}).collect()
    assert {r.metric: (r.cases, r["mean"], r.whole) for r in rows} == {"notes": (3, 0.3333, 1), "rules": (0, None, 0)}
