"""The literal cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from catalogsmith.functions import text as t
from catalogsmith.operators import correct
from catalogsmith.schema import find_column, is_blank, matches, parse_target, target_parts


def check(spark, rule, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string").select("i", rule(F.col("v")).alias("got")).orderBy("i").collect()
    assert [r.got for r in rows] == [c[1] for c in cases]


def test_dates(spark):
    cases = [("1999, June", "1999-06"), ("Junio 2004", "2004-06"), ("June-July 1999", "1999"), ("1999.", "1999"), (" 2001 ", "2001"), ("2024-05-12", "2024-05-12"), ("2024-05", "2024-05"), ("", ""), (None, ""), ("(n.d.)", "n.d"), ("sept 2010", "2010-09"), ("mayo de 1987", "1987-05"), ("no year", "no year")]
    check(spark, t.clean_date, cases)


def test_blank(spark):
    check(spark, is_blank, [(None, True), ("", True), (" \t", True), ("NaN", True), ("None", True), ("x", False), ("none such", False)])


def test_types(spark):
    lit = F.lit
    row = spark.range(1).select(
        t.infer_type(lit("nan"), lit("1234-5678"), lit(""), lit(""), lit("")).alias("a"), t.infer_type(lit(""), lit(""), lit("978"), lit(""), lit("")).alias("b"), t.infer_type(lit(""), lit(None).cast("string"), lit(""), lit(""), lit("A Master Thesis")).alias("c"), t.infer_type(lit("Libro "), lit(""), lit(""), lit(""), lit("")).alias("d"), t.infer_type(lit(""), lit(""), lit(""), lit("vol. 3"), lit("")).alias("e"),
    ).first()
    assert list(row) == ["Articulo", "Libro", "Tesis", "Libro", "Articulo"]


def test_similarity(spark):
    check(spark, t.similarity, [("NO_DUPLICATE", 0.0), (None, 0.0), ("", 0.0), ("0.85", 85.0), ("1.0", 100.0), ("95.5", 95.5), ("high", 100.0), ("0", 0.0)])


def test_identifiers(spark):
    check(spark, t.clean_doi, [("https://doi.org/10.1/a", "10.1/a"), ("DOI: 10.2/b", "10.2/b"), ("http://dx.doi.org/10.3/c", "10.3/c"), ("10.4/d", "10.4/d"), (None, "")])
    check(spark, t.clean_isbn, [("978-0-306-x", "9780306X"), (None, "")])


def test_separators(spark):
    check(spark, t.canonical_separators, [("a|||b|c||d", "a||b||c||d"), ("nan", ""), ("a", "a"), (None, "")])
    check(spark, t.language_code, [("Spanish", "es"), (" english", "en"), ("FR", "fr"), ("Klingon", "Klingon")])


def test_spaced_and_cyclic(spark):
    check(spark, t.spaced_characters, [("E s t i m a r  T e x t u r a s", True), ("Estimar Texturas", False), ("a b", False)])
    check(spark, t.join_spaced, [("E s t i m a r  T e x t u r a s", "EstimarTexturas"), ("plain words here", "plain words here")])
    unit = "a sentence of words; "
    check(spark, t.cut_cycle, [("Intro " + unit * 3 + "tail", "Intro a sentence of words"), ("no repetition at all in this text", "no repetition at all in this text")])


def test_cid_glued_names(spark):
    check(spark, t.replace_cid, [("di(cid:27)erent", "different"), ("x (cid:99) y", "x y"), ("none", "none")])
    check(spark, t.split_glued, [("unaPalabra2x", "una Palabra 2 x")])
    check(spark, lambda c: t.split_names(c, t.INITIAL_BORDER), [("S. AbdelhameedK. AbelingN. J. Abicht", ["S. Abdelhameed", "K. Abeling", "N. J. Abicht"])])
    check(spark, t.distinct_values, [("Pérez, J|PEREZ, J| |Díaz", "Pérez, J|Díaz"), ("Solo", "Solo")])


def test_arrow_functions(spark):
    check(spark, t.ascii_fold, [("ñandú", "nandu"), (None, None)])
    check(spark, t.unescape_html, [("a &amp; b &eacute;", "a & b é"), (None, None)])


def test_repairs(spark):
    check(spark, lambda c: correct.map_values(c, {"June": "06", "July": "07"}), [("1999, June", "1999, 06"), ("July 2000", "07 2000"), ("x", "x")])
    check(spark, lambda c: correct.extract(c, r"\b((?:19|20)\d\d)\b"), [("June-July 1999", "1999"), ("Primavera 2004", "2004"), ("none", "none")])


def test_author_cap(spark):
    many = "||".join(f"A{i}" for i in range(35))
    row = spark.range(1).select(correct.cap_authors(F.lit(many), F.lit("Own 1||Own 2")).alias("a"), correct.cap_authors(F.lit("x||y"), F.lit("Own 1")).alias("b"), correct.cap_authors(F.lit(many), F.lit("")).alias("c")).first()
    assert list(row) == ["Own 1||Own 2", "x||y", many]


@pytest.mark.parametrize("name,parts", [("dc.title[es]", ("dc", "title", None, "es")), ("dc.date.issued", ("dc", "date", "issued", None)), ("local.a.b.c", ("local", "a", "b.c", None))])
def test_target_names(name, parts):
    assert target_parts(name) == parts and parse_target(name)


def test_columns():
    assert matches("dc.title*", "dc.title[es]") and not matches("dc.title[es]", "dc.titlee") and matches("dc.title[es]", "dc.title[es]")
    assert find_column(["X", "Item Title", "title"], ["title", "item title"]) == "Item Title"


def test_folding_sends_little_to_python(spark, data):
    """texts of ASCII stay in the JVM, and batches of others are small, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    df = t.small_batches(spark.createDataFrame([("plain",), (None,), ("ñandú ﬁ 中x",), ("",)], "c string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
    assert [r[0] for r in df.select(t.ascii_fold("c")).collect()] == ["plain", None, "nandu  x", ""]
    plan = df.select(t.ascii_fold("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in plan


def test_detectors_by_prefilter_are_the_plain_rules(spark):
    """F8, F9: blank values by one anchored pattern, shares of words made once, over odd texts, against plain Python."""
    import random
    import re

    rng = random.Random(9)
    texts = [None, "", " ", "\n\t  ", " NaN ", " none\n", "none x", "nan\n\n", "nanone", "null", "  " * 2000 + "x"]
    texts += ["".join(rng.choice(["a", "b", " ", "  ", "\n", "-", "word", "x" * 33]) + rng.choice(["", " "]) for _ in range(rng.randrange(2, 24))) for _ in range(1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string")
    got = df.select("i", is_blank(F.col("c")).alias("blank"), t.spaced_characters(F.col("c")).alias("spaced"), t.glued_words(F.col("c")).alias("glued")).collect()

    def shares(x, by, some, least):
        words = [w for w in re.split(by, x or "", flags=re.A) if w]
        return len(x or "") >= 5 and len(words) >= least and sum(map(some, words)) / len(words)

    for r in got:
        x = texts[r.i]
        assert r.blank == (x is None or x.strip().lower() in ("", "nan", "none")), repr(x)
        assert r.spaced == (shares(x, r"\s+", lambda w: len(w) == 1, 8) > 0.6), repr(x)
        assert r.glued == (shares(x, r"[\s\-_/]+", lambda w: len(w) > 30, 1) > 0.15), repr(x)
    assert sum(r.spaced for r in got) > 50 and sum(r.glued for r in got) > 50
