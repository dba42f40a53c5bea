"""The harvest runs over all records."""

from catalogsmith.plans.record_queries import QUERIES
from catalogsmith.plans.views import view


def test_harvest_of_all_records(spark, data):
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got, records = QUERIES["a9_json_harvest"](spark, data).collect(), view(spark, data, "records").collect()
    print("harvested", len(got), "of", len(records))
    assert key((r.title, r.author, r.year, r.month, r.abstract, r.doi) for r in got) == key((r.title, r.author, "2011", "03", r.citation, r.doi) for r in records)
