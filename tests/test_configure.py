import zipfile

from pyspark.sql import functions as F

from catalogsmith.operators import join
from catalogsmith.operators.crosswalk import Mapping
from catalogsmith.plans import configure
from catalogsmith.sources import readers, writers


def test_generation_stores_and_reuses(spark, tmp_path):
    df = spark.createDataFrame([("1", "T", "A; B", "2001", "Libro")], "id string, title string, Who string, date string, type string")
    path, asked = str(tmp_path / "map.json"), []

    def propose(columns, failed):
        asked.append((list(columns), failed))
        right = Mapping("Who", "Author")
        return [Mapping("gone", "doi"), Mapping("Who", "weird")] if failed is None else [right, Mapping("id", "doi")]

    plan, check = configure.generate(df, path, propose)
    assert [a[0] for a in asked] == [["Who"], ["Who"]] and asked[1][1]["missing"] == ["author"]
    assert check == {"missing": [], "unsplit": []} and plan.settings.original_separator == ";"
    assert [(m.left, m.replace) for m in plan.mappings] == [("id", "id"), ("title", "title"), ("date", "date"), ("type", "type"), ("Who", "author")]
    assert configure.generate(df, path)[0] == plan and len(asked) == 2
    assert configure.stored(path, df.drop("Who")) is None and configure.stored(str(tmp_path / "none"), df) is None


def test_generation_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id string, title string")
    assert configure.generate(df, str(tmp_path / "m.json"))[1]["missing"] == ["id", "title", "author", "date", "type"]


def test_run_folder(tmp_path):
    assert configure.run_folder(str(tmp_path / "runs"), "s", "d").endswith("/runs/s_d_1")
    for name in ("s_d_1", "s_d_2", "s_e_1"):
        (tmp_path / name).mkdir()
    assert configure.run_folder(str(tmp_path), "s", "d") == str(tmp_path / "s_d_3")


def test_line_fields(spark):
    lines = {"a,b": ["a", "b"], ",": ["", ""], "": [""], '"x, ""y""",,z': ['x, "y"', "", "z"], '"open,b': ['"open', "b"], ",".join(map(str, range(200))): list(map(str, range(200)))}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.c for r in df.select("line", readers.line_fields(F.col("line")).alias("c")).collect()} == lines
    long = df.limit(1).select(F.length(readers.line_fields(F.concat(F.lit('"'), F.repeat(F.lit('x""'), 300_000), F.lit('"')))[0]).alias("n"))
    assert long.first().n == 600_000
    merged = df.where("line = ','").select(readers.merge_surplus(F.lit("a,b,c,,e"), 3).alias("m"))
    assert merged.first().m == ["a,b,c", "", "e"]
    assert df.limit(1).select(readers.merge_surplus(F.lit("a|b"), 3, "|").alias("m")).first().m == ["a", "b"]


def test_page_text_and_calls():
    pages = lambda content, n: [f"p{i}" for i in range(n)] if content else ["  "]
    ocr = lambda content, n: ["seen"] * n
    assert readers.page_text(b"x", pages, ocr) == "p0\np1\np2" and readers.page_text(b"", pages, ocr) == "seen\nseen"
    assert len(readers.page_text(b"x", lambda c, n: ["y" * 5000], ocr)) == 3000

    waits, failures = [], [ConnectionError(), TimeoutError()]

    def call():
        if failures:
            raise failures.pop()
        return "done"

    def absent():
        raise FileNotFoundError

    assert readers.fetched(call, {}, wait=waits.append) == "done" and waits == [2, 4]
    assert readers.fetched(absent, {}) == {}


def test_objects_keep_whole_fields(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    good, _ = readers.ingest(spark, str(tmp_path), lambda content: {"description": "d" * 10_000})
    assert good.select(F.length("description")).first()[0] == 10_000
    (tmp_path / "a.csv").write_text("id,title\n1,T\n")
    table, failures = readers.ingest(spark, str(tmp_path / "a.csv"))
    assert table.collect() == [("1", "T")] and failures is None


def test_directories_and_archive(spark, tmp_path):
    files = spark.createDataFrame([("item_001/contents", "a.pdf"), ("item_001/dublin_core.xml", "<x/>"), ("item_002/contents", "é")], "path string, content string")
    for _ in range(2):
        done = writers.write_directories(files, str(tmp_path / "saf"))
        assert {r.item: r.files for r in done.collect()} == {"item_001": 2, "item_002": 1}
    found = {str(p.relative_to(tmp_path / "saf")): p.read_text() for p in (tmp_path / "saf").rglob("*") if p.is_file()}
    assert found == {r.path: r.content for r in files.collect()}
    assert writers.write_archive(files, str(tmp_path / "all.zip")) == 3
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert z.namelist() == ["item_001/contents", "item_001/dublin_core.xml", "item_002/contents"]
        assert z.read("item_002/contents").decode() == "é" and z.infolist()[0].compress_type == zipfile.ZIP_DEFLATED


def test_pairs_of_two_blocks_count_once(spark):
    fields = "id string, title string, author string, date string, doi string"
    one = spark.createDataFrame([("r1", "A study of many things", "X", "2001", "10.1/A"), ("r1", "A study of many things", "X", "2001", "10.1/A"), ("r2", "", "X", "2001", "10.1/b")], fields)
    other = spark.createDataFrame([("s1", "A study of many things", "X", "2001", "10.1/a"), ("s2", "Else", "X", "2001", "10.1/B"), ("s3", "", "", "", "")], fields)
    assert sorted((r.r_id, r.s_id) for r in join.candidate_pairs(one, other).collect()) == [("r1", "s1"), ("r2", "s2")]
