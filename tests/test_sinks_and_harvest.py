"""The package sink, the parallel archive and harvests, round trips and failures."""

import glob
import os
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalogsmith.sources import harvest, packages, writers


def _records(spark, n=40):
    rows = [(i, f"Título {i} <&>", "A||B" if i % 3 else "", f"{i}/á file.pdf||x/b{i}.txt" if i % 2 else "") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "n long, `dc.title[es]` string, `local.note` string, files string")


def _tree(root):
    return {p: open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if (p := os.path.relpath(os.path.join(d, f), root))}


def test_packages_are_committed_whole(spark, tmp_path):
    df = _records(spark)
    files = writers.package_files(df, "n")
    uri = f"file://{tmp_path}/out"
    packages.write_package_tree(files, uri)
    want = {r.path: r.content.encode() for r in files.collect()}
    assert {r.path: bytes(r.content) for r in packages.read_package_tree(spark, uri).collect()} == want
    assert not glob.glob(f"{tmp_path}/out/.staging*")
    batches = {p.split("/")[1]: p.split("/")[0] for p in sorted(_tree(tmp_path / "out")) if "/" in p}
    assert all(batches[p.split("/")[1]] == p.split("/")[0] for p in _tree(tmp_path / "out") if "/" in p)  # no item in two batches
    packages.write_package_tree(files.where("path like 'item_001/%'"), uri, "overwrite")
    assert {r.path for r in packages.read_package_tree(spark, uri).collect()} == {p for p in want if p.startswith("item_001/")}


def test_files_are_copied_by_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/á file.pdf").write_bytes(b"x" * 100_000)
    (tmp_path / "in/b.txt").write_bytes(b"")
    df = spark.createDataFrame([(1, "t", f"{tmp_path}/in/á file.pdf||{tmp_path}/in/b.txt"), (2, "u", "")], "n long, `dc.title` string, files string")
    files = writers.package_files(df, "n").withColumn("content", F.col("content").cast("binary")).withColumn("source", F.lit(None).cast("string"))
    packages.write_package_tree(files.unionByName(packages.bitstreams(df, "n")), f"file://{tmp_path}/out")
    found = {r.path: bytes(r.content) for r in packages.read_package_tree(spark, f"file://{tmp_path}/out").collect()}
    listed = found["item_001/contents"].decode().split("\n")
    assert len(listed) == 2 and [len(found[f"item_001/{n}"]) for n in listed] == [100_000, 0]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = _records(spark)
    files = writers.package_files(df, "n")
    uri = f"file://{tmp_path}/out"
    packages.write_package_tree(files.where("path like 'item_002/%'"), uri)
    before = _tree(tmp_path / "out")
    bad = files.select("path", F.col("content").cast("binary").alias("content"), F.when(F.col("path").like("item_009/%"), "file:///nowhere/at/all").alias("source"))
    with pytest.raises(Exception, match="nowhere"):
        packages.write_package_tree(bad, uri)
    assert _tree(tmp_path / "out") == before


def test_archive_in_parallel(spark, tmp_path):
    df = _records(spark, 200)
    files = writers.package_files(df, "n").unionByName(spark.createDataFrame([("item_500/é.txt", "ü" * 500_000), ("item_501/none.txt", None)], "path string, content string"))
    n = packages.write_archive_parallel(files.repartition(5), f"file://{tmp_path}/a.zip")
    want = {r.path: (r.content or "").encode() for r in files.collect()}
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and n == len(want) and z.namelist() == sorted(want)
        assert {i: z.read(i) for i in z.namelist()} == want
    assert os.listdir(tmp_path) == ["a.zip"]
    assert packages.write_archive_parallel(files.where("false"), f"file://{tmp_path}/none.zip") == 0
    assert zipfile.ZipFile(tmp_path / "none.zip").namelist() == []


def served(start, size, wanted):
    """The pages table as a service of at most 70 rows a page; every third call fails once."""
    flag = os.environ["SERVED_FLAGS"] + f"/{start}"
    if start % 3 == 1 and not os.path.exists(flag):
        open(flag, "w").close()
        raise ConnectionError("lost")
    rows = pq.read_table(os.environ["SERVED_TABLE"]).to_pylist()
    for c, v in wanted.items():
        open(os.environ["SERVED_FLAGS"] + f"/wanted-{c}", "w").close()
        rows = [r for r in rows if str(r[c]) == str(v)]
    return {"total": len(rows), "records": rows[start : start + size]}


def test_harvest_learns_its_size(spark, data, tmp_path, monkeypatch):
    monkeypatch.setenv("SERVED_TABLE", f"{data}/pages.parquet")
    monkeypatch.setenv("SERVED_FLAGS", str(tmp_path))
    monkeypatch.setattr("time.sleep", lambda s: None)
    env = {k: os.environ[k] for k in ("SERVED_TABLE", "SERVED_FLAGS")}
    (tmp_path / "served_pages.py").write_text(f"import os\nos.environ.update({env!r})\nimport sys\nsys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})\nfrom tests.test_sinks_and_harvest import served\n")
    spark.sparkContext.addPyFile(str(tmp_path / "served_pages.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    want = {r["page_id"]: r["url"] for r in pq.read_table(f"{data}/pages.parquet").to_pylist()}
    made = lambda **o: harvest.harvest(spark, "served_pages:served", schema="position long, page_id string, url string", **o)
    got = made(size=7).collect()
    assert {int(r.page_id): r.url for r in got} == want and sorted(r.position for r in got) == list(range(len(want)))
    assert made(size=7, tasks=3).rdd.getNumPartitions() <= 3
    late = made(size=7, begin=20).collect()
    assert sorted(r.position for r in late) == list(range(20, len(want)))
    assert made(size=7, rows=10).count() == 10 and made(size=7, rows=0).count() == 0 and made(begin=10_000).count() == 0
    url = sorted(want.values())[3]
    one = made(size=7, filters="url").where(F.col("url") == url)
    assert {r.url for r in one.collect()} == {url}
    assert os.path.exists(tmp_path / "wanted-url")
