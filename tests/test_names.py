"""Names and orders that must be exactly these."""

import pytest

from catalogsmith.operators import correct, crosswalk, validate


def test_canonical_order(spark):
    df = spark.createDataFrame([("1", "p", "x", "t")], "id string, place string, _internal string, title string")
    assert correct.canonical_columns(df).columns == ["id", "title", "author", "description", "date", "type", "subject", "issn", "isbn", "doi", "citation", "rights", "rightsurl", "place"]


@pytest.mark.parametrize("name", ["Document Title", "item_title", "article doi", "dcterms.title[es]", "DC.Title", "document_doi"])
def test_a_title_or_doi_is_enough(spark, name):
    assert validate.check_source(spark.createDataFrame([("x", "y")], f"`{name}` string, author string"))


def test_repositories_need_title_and_id(spark):
    validate.check_repository(spark.createDataFrame([("x", "y")], "title string, pmid string"))
    for bad in ("title string, uuid string", "uri string, name string"):
        with pytest.raises(validate.InvalidInput):
            validate.check_repository(spark.createDataFrame([("x", "y")], bad))


def test_usual_keys_come_in_their_order():
    assert validate.resolve_key(["url", "DOI", "uri"]) == "DOI" and validate.resolve_key(["a", "id"], "b + a") == "a" and validate.resolve_key(["uuid"]) is None


def test_crosswalk_unescapes_all_entities(spark):
    df = spark.createDataFrame([("Caf&eacute;&nbsp;&#233;&amp;lt; x",), ("plain",), (None,)], "t string")
    mapping = crosswalk.Mapping("t", "v")
    got = [r.v for r in df.select(crosswalk.compile_mapping(mapping, df.columns, crosswalk.Crosswalk((), crosswalk.Settings("|", ";"))).alias("v")).collect()]
    assert got == ["Café\xa0é&lt; x", "plain", ""]
