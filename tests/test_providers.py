"""Records of services, whole, sparse and odd."""

import json

from pyspark.sql import functions as F

from catalogsmith.functions import providers


def parsed(spark, name, *records):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, v string")
    return [r.x.asDict() for r in rows.select("i", providers.PARSERS[name](F.col("v")).alias("x")).orderBy("i").collect()]


def test_crossref(spark):
    whole = {"title": ["A", "B"], "author": [{"family": "Paz", "given": "Ana"}, {"family": "Solo"}, {"given": "Eva"}], "published": {"date-parts": [[2011, 3]]}, "ISSN": ["1234-5678"], "publisher": "P", "type": "t", "abstract": "x", "container-title": ["J"]}
    got = parsed(spark, "crossref", whole, {}, {"title": [], "published": {"date-parts": [[]]}})
    assert got[0] == {"title": "A", "authors": "Paz, Ana || Solo || Eva", "year": "2011", "publisher": "P", "issn": "1234-5678", "type": "t", "abstract_en": "x", "journal": "J"}
    assert set(got[1].values()) == set(got[2].values()) == {""}


def test_openalex(spark):
    whole = {"title": "A", "authorships": [{"author": {"display_name": "Ana Paz"}}, {"author": {}}, {"author": {"display_name": "Eva"}}], "publication_year": 2011, "doi": "d", "type": "t", "primary_location": {"source": {"display_name": "J", "issn_l": "1"}}, "open_access": {"is_oa": True}, "cited_by_count": 7}
    got = parsed(spark, "openalex", whole, {"primary_location": None})
    assert got[0] == {"title": "A", "authors": "Ana Paz || Eva", "year": "2011", "doi": "d", "type": "t", "journal": "J", "issn": "1", "open_access": "True", "citations": "7"}
    assert set(got[1].values()) == {""}


def test_csl(spark):
    whole = {"title": ["A"], "author": [{"family": "Paz", "given": "Ana"}, {"literal": "Group"}, {}], "issued": {"date-parts": [["2011", 1]]}, "container-title": "J", "volume": "3", "issue": "4", "DOI": "d", "page": "1-2"}
    got = parsed(spark, "csl", whole, {"title": "B", "issued": {"date-parts": [["soon"]]}, "issue": "9"})
    assert got[0]["title"] == "A" and got[0]["authors"] == "Ana Paz || Group" and got[0]["year"] == "2011" and got[0]["journal"] == "J" and got[0]["volume_and_issue"] == "vol. 3, no. 4"
    assert got[1]["title"] == "B" and got[1]["year"] == "" and got[1]["volume_and_issue"] == "no. 9" and got[1]["journal"] is None


def test_openlibrary(spark):
    got = parsed(spark, "openlibrary", {"title": "A", "subtitle": "b", "authors": [{"name": "Ana"}, {}], "publish_date": "May 1999", "subjects": [{"name": str(i)} for i in range(12)], "number_of_pages": 0}, {})
    assert got[0] == {"title": "A: b", "authors": "Ana", "publisher": None, "year": "1999", "pages": None, "subjects": ", ".join(map(str, range(10))), "type": "Libro"}
    assert got[1]["title"] is None and got[1]["authors"] == got[1]["year"] == ""
