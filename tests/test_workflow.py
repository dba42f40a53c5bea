"""Submissions' states, and pages by cursor."""

from catalogsmith.operators import search, workflow


def test_transitions(spark):
    items = spark.createDataFrame([(1, "workspace"), (2, "workspace"), (3, "pool"), (4, "claimed"), (5, "archived"), (6, None), (None, "pool")], "id int, state string")
    actions = spark.createDataFrame([(1, 2, "claim"), (1, 1, "submit"), (2, 1, "approve"), (3, None, "claim"), (4, 1, "reject"), (4, 1, "unclaim"), (5, 1, "expunge"), (6, 1, "submit"), (None, 1, "claim"), (9, 1, "claim"), (3, 1, None)], "id int, pos int, action string")
    got = {r.id: (r.state, r.outcome) for r in workflow.apply_actions(items, actions).collect()}
    assert got == {1: ("pool", "done"), 2: ("workspace", "refused"), 3: ("pool", None), 4: ("workspace", "done"), 5: ("archived", "refused"), 6: (None, "refused"), None: ("pool", None)}
    assert workflow.apply_actions(items.where("false"), actions).count() == 0
    assert workflow.apply_actions(items, actions.where("false")).where("outcome is not null").count() == 0


def test_cursor_pages_cover_all(spark):
    rows = [(i, v) for i, v in enumerate([3, None, 1, 3, 2, None, 3, 1, None])]
    df = spark.createDataFrame(rows, "id int, v int")
    for sort in ("v", "v:desc", None):
        whole = [r.id for r in search.sorted_by(df, sort, "id").collect()]
        seen, cursor = [], None
        while page := search.search(df, "id", sort=sort, rows=2, cursor=cursor).collect():
            seen += [r.id for r in page]
            cursor = (page[-1].v, page[-1].id) if sort else (page[-1].id,)
        assert seen == whole and len(whole) == len(rows)


def test_agency_licenses_archived(spark):
    works = spark.createDataFrame([(1, "10.1/a", "cc"), (2, "10.2/b", None), (3, None, "cc"), (4, " 10.1/c/d", "own")], "id int, doi string, license string")
    registrants = spark.createDataFrame([("10.1", "B"), ("10.1", "A"), (None, "N")], "prefix string, agency string")
    assert {r.id: r.agency for r in search.agency(works, "doi", registrants).collect()} == {1: "A", 2: None, 3: None, 4: "A"}
    assert {tuple(r) for r in search.licenses(works, "license").collect()} == {("cc", 2), ("own", 1)}
    items = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, None, "c")], "id int, archived boolean, name string")
    new = spark.createDataFrame([(i, True, "new") for i in (1, 2, 3, 4)], "id int, archived boolean, name string")
    assert {r.id: r.name for r in search.replace_archived(items, new, "id", "archived").collect()} == {1: "new", 2: "b", 3: "c"}
