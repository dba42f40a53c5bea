"""Operators on small tables, and invariants of the whole flow."""

import pytest
from pyspark.sql import functions as F

from catalogsmith.operators import aggregate, crosswalk, join, profile, sanitize, search, validate
from catalogsmith.plans import pipeline
from catalogsmith.schema import dense_numbers, with_row_id
from catalogsmith.sources import readers, writers
from catalogsmith.streaming import records


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reconcile(spark):
    source = spark.createDataFrame([("doc_1",), ("doc_2",), ("doc_3",), (None,)], "id string")
    edges = spark.createDataFrame([("r1", "doc_1", 95.5), ("r2", "doc_2", 4.2), ("r3", None, 99.0)], "id_document1 string, id_document2 string, similarity double")
    assert rows(join.without_duplicates(source, edges)) == rows(source.where("id is null or id != 'doc_1'"))
    totals = spark.createDataFrame([("doc_1", "95.5"), ("doc_2", "x")], "id string, total string")
    assert rows(join.below_threshold(source, totals)) == [("doc_2",)]


def test_fill_keeps_rows(spark):
    df = spark.createDataFrame([("1", "", "a"), ("2", "own", ""), ("3", "nan", "c")], "id string, author string, doi string")
    lookup = spark.createDataFrame([("1", "G", "d"), ("1", "H", "e"), ("2", "G2", "d2")], "id string, author string, doi string")
    assert rows(join.fill_blank(df, lookup, "id", ["author", "doi"])) == [("1", "G", "a"), ("2", "own", "d2"), ("3", "nan", "c")]


def test_replay_last_wins(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string")
    log = spark.createDataFrame([(1, "1", "title", "x"), (2, "1", "title", "y")], "seq int, row_id string, column string, cleaned string")
    assert rows(join.replay(df, log, "id", ["title"])) == [("1", "y"), ("2", "b")]


def test_duplicates_score(spark):
    cols = "id string, title string, author string, date string, doi string"
    a = spark.createDataFrame([("r1", "A study of things", "Pérez, J", "2001", ""), ("r2", "Other", "X", "1999", "10.1/Z")], cols)
    b = spark.createDataFrame([("s1", "A Study of Things", "Perez, J", "2001", ""), ("s2", "Unrelated", "Y", "1990", "10.1/z")], cols)
    found = {(r.id_document1, r.id_document2): r.similarity for r in join.duplicate_edges(a, b).collect()}
    assert found[("r1", "s1")] == 100.0 and set(found) == {("r1", "s1"), ("r2", "s2")}


def test_quarantine_and_log(spark):
    df = spark.createDataFrame([(0, " a ", "June 1999", "", "", "vol 1", "t"), (1, "", "", "x", "", "", ""), (2, "c", "2001", "Libro", "Z", "", "")], "_row_id long, id string, date string, type string, author string, citation string, title string")
    out = sanitize.sanitize(df)
    assert [(r.id, r.date, r.type, r.author) for r in out.records.orderBy("_row_id").collect()] == [("a", "1999-06", "Articulo", "Desconocido"), ("c", "2001", "Libro", "Z")]
    assert [(r.id, r.quarantine_reason) for r in out.quarantine.collect()] == [("item_2", "missing date")]
    assert ("sanitizer", "date", 0, "June 1999", "1999-06") in [tuple(r) for r in out.log.collect()]
    with pytest.raises(ValueError):
        sanitize.fail_if_nothing_left(out.records.where("false"))


def test_crosswalk_shapes_and_missing_columns(spark):
    m = [{"left": "a+b", "replace": "x"}, {"left": "dc.t[es]", "replace": "y", "filter": "trim|lowercase"}, {"left": "zz", "replace": "z", "default": "none"}]
    for shape in ({"mappings": m}, [m], [m, {}], m):
        assert len(crosswalk.Crosswalk.load(shape).mappings) == 3
    df = spark.createDataFrame([("1", "", " T&amp;, ", "q")], "a string, b string, `dc.t[es]` string, other string")
    assert rows(crosswalk.apply(df, crosswalk.Crosswalk.load(m))) == [("1", "t&", "none")]
    assert crosswalk.remnants(df.columns, crosswalk.Crosswalk.load(m)) == ["other"]
    assert crosswalk.Crosswalk.load(m).missing_columns(df.columns) == ["zz"]


def test_triage_and_curation(spark):
    df = spark.createDataFrame([("1", "fine title", "A", "x"), ("2", "di(cid:27)erent", "B", "x"), ("3", "", "", ""), ("4", "bell\x07", "B", "x")], "id string, title string, author string, type string")
    curated, review = profile.curate(df, df.columns)
    assert {r.id: r.title for r in curated.collect()} == {"1": "fine title", "2": "different"} and {r.id for r in review.collect()} == {"3", "4"}
    assert curated.count() + review.count() == df.count()


def test_query_language(spark):
    df = spark.createDataFrame([(1, "Deep sea fish", 1990), (2, "deep learning", 2015), (3, "fish soup", 2016)], "id int, title string, year int")
    fields = {"title": "title", "year": "year"}
    find = lambda q: [r.id for r in df.where(search.parse_query(q, fields, ["title"])).orderBy("id").collect()]
    assert find("deep AND fish") == [1] and find("deep OR soup") == [1, 2, 3] and find("fish year:[2000 TO *]") == [3] and find('"deep learning"') == [2] and find("title:fish NOT soup") == [1] and find("(deep OR soup) year:2016") == [3]
    with pytest.raises(KeyError):
        search.parse_query("nothing:x", fields, ["title"])


def test_numbers_are_dense(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "k")
    assert [r.n for r in dense_numbers(df, "k", "n").orderBy("k").collect()] == list(range(1, 1001))


def test_keys(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a")], "item_id string, title string")
    assert validate.discover_key(df) == "item_id"
    with pytest.raises(validate.InvalidInput):
        validate.check_source(df.where("false"))
    assert not validate.integrity(df, df.limit(1), "item_id").first().valid


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"\nthere', "a|b"), ("2", "", "c")], "id string, title string, author string")
    writers.write_records(df, str(tmp_path / "out"), one_file=True)
    assert rows(readers.read_records(spark, str(tmp_path / "out"), ",")) == rows(df)
    (tmp_path / "semi.csv").write_text("﻿id;title\n1;a\n2;b\n")
    assert readers.detect_delimiter(spark, str(tmp_path / "semi.csv")) == ";" and readers.read_records(spark, str(tmp_path / "semi.csv")).columns == ["id", "title"]
    assert readers.read_or_empty(spark, str(tmp_path / "absent.csv"), "id string").count() == 0


def test_objects(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def extractor(content):
        if content == b"bad":
            raise ValueError("broken")
        return {"title": "T", "author": ["A", "B"]}

    good, bad = readers.extract_objects(readers.list_objects(spark, str(tmp_path)), extractor)
    assert [r.author for r in good.collect()] == ["A|B"] and bad.count() == 1


def test_packages(spark):
    df = spark.createDataFrame([("x/ñ.pdf", "A & B", "P||Q", 1)], "files string, `dc.title[es]` string, `local.creator` string, n int")
    files = {r.path: r.content for r in writers.package_files(df.select("files", "`dc.title[es]`", "`local.creator`", "n"), "n").collect()}
    assert files["item_001/contents"] == "n.pdf" and '<dcvalue element="title" language="es">A &amp; B</dcvalue>' in files["item_001/dublin_core.xml"]
    assert files["item_001/metadata_local.xml"].startswith('<dublin_core schema="local">') and files["item_001/metadata_local.xml"].count("<dcvalue") == 2


def test_pipeline_never_grows(spark):
    source = with_row_id(spark.createDataFrame([("s1", "A study of things", "Perez, J", "June 2001", "Libro"), ("s2", "New work", "X", "1999", ""), ("s3", "No date", "X", "", "Libro")], "id string, title string, author string, date string, type string"))
    repository = spark.createDataFrame([("r1", "A study of things", "Perez, J", "2001", "Libro")], "id string, title string, author string, date string, type string")
    out = pipeline.run(source, repository, pipeline.PipelineParams(duplicate_threshold=60.0))
    assert not out.errors and out.tables["reconciled"].count() == 0 and out.tables["quarantine"].count() == 2
    assert pipeline.run(source.where("false"), repository, pipeline.PipelineParams()).errors
    assert "edges" not in pipeline.run(source, repository, pipeline.PipelineParams(), until="sanitize").tables


def test_stream_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "June 1999", "", "A", "vol 1", "t"), (1, "b", "", "", "", "", "")], "_row_id long, id string, date string, type string, author string, citation string, title string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    records.route(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    batch = records.sanitized_stream(df)
    assert spark.read.parquet(str(tmp_path / "good")).count() == batch.where("quarantine_reason is null").count() == 1


def test_top_k_and_pages(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 10).alias("score"))
    assert [r.id for r in aggregate.top_k(df, "score", "id", 3).collect()] == [0, 10, 20]
    assert [r.id for r in aggregate.keyset_page(df, "id", 50, 3).collect()] == [51, 52, 53]


def test_row_ids_are_contiguous(spark):
    df = spark.range(1000).repartition(7, "id").where("id % 13 != 0")
    ids = sorted(r._row_id for r in with_row_id(df).collect())
    assert ids == list(range(len(ids))) and with_row_id(df.where("false")).count() == 0
