"""Pages that changed, and sitemaps in bounded files."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from larkspur.sources import sinks
from larkspur.sources.files import folder_of

PAGES = "slug string, html string, extra int"


def pages(spark, found):
    return spark.createDataFrame([(k, v, 1) for k, v in found.items()], PAGES)


def written(spark, path):
    return {r["slug"]: r["value"] for r in spark.read.schema("value string, slug string").text(path).collect()}


def times(path):
    return {d: max(os.stat(f"{path}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("slug=")}


def test_only_what_changed_is_written(spark, tmp_path):
    path = str(tmp_path / "site")
    first = {"a": "<p>1</p>", "b": "two\nlines", "c/d e": "odd key", "gone": "x", "empty": None}
    assert sorted(map(tuple, sinks.publish_pages(pages(spark, first | {None: "no key"}), path).collect())) == sorted((k, "new") for k in first)
    before = times(path)
    second = {"a": "<p>1</p>", "b": "two\nlines changed", "c/d e": "odd key", "empty": None, "new": "n"}
    assert sorted(map(tuple, sinks.publish_pages(pages(spark, second), path).collect())) == [("b", "changed"), ("gone", "removed"), ("new", "new")]
    after = times(path)
    assert {d for d in after if before.get(d) != after[d]} == {"slug=b", "slug=new"} and "slug=gone" not in after
    assert sinks.publish_pages(pages(spark, second), path).collect() == [] and times(path) == after
    assert written(spark, path)["c/d e"] == "odd key" and set(written(spark, path)) == set(second)


def test_a_run_that_failed_before_its_commit_is_made_good(spark, tmp_path):
    path = str(tmp_path / "site")
    sinks.publish_pages(pages(spark, {"a": "1", "b": "1"}), path)
    os.remove(f"{path}/_manifest/v=0/_SUCCESS")  # as if that run had not come to its end
    assert sorted(map(tuple, sinks.publish_pages(pages(spark, {"a": "2"}), path).collect())) == [("a", "new")]
    assert sinks.publish_pages(pages(spark, {"a": "2"}), path).collect() == []


def test_a_page_with_odd_keys_is_removed_by_its_folder(spark, tmp_path):
    path = str(tmp_path / "site")
    sinks.publish_pages(pages(spark, {"a=b/c%:": "1", "x": "1"}), path)
    sinks.publish_pages(pages(spark, {"x": "1"}), path)
    assert [d for d in os.listdir(path) if d.startswith("slug=")] == ["slug=x"]


def test_pages_of_a_run_that_failed_between_pages_and_manifest_are_written_again(spark, tmp_path, monkeypatch):
    """Whatever the manifest says: a page set back to what the manifest holds, one that came with the failed run and went again, one that went."""
    path, parquet = str(tmp_path / "site"), DataFrameWriter.parquet
    sinks.publish_pages(pages(spark, {"a": "1", "b": "1", "gone": "1"}), path)

    def fails(self, to, *args, **named):
        if to.endswith("/_manifest/v=1"):
            raise OSError("lost")
        return parquet(self, to, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", fails)
    with pytest.raises(OSError, match="lost"):
        sinks.publish_pages(pages(spark, {"a": "1", "b": "2", "came": "1"}), path)
    monkeypatch.undo()
    assert sorted(map(tuple, sinks.publish_pages(pages(spark, {"a": "1", "b": "1"}), path).collect())) == [("b", "changed"), ("came", "removed"), ("gone", "removed")]
    assert written(spark, path) == {"a": "1", "b": "1"}
    assert sinks.publish_pages(pages(spark, {"a": "1", "b": "1"}), path).collect() == []


def test_pages_of_one_small_file_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    path, seen, put = str(tmp_path / "site"), str(tmp_path), sinks.put

    def told(store, rows, name):
        found = list(rows)
        with open(f"{seen}/task-{TaskContext.get().partitionId()}", "w") as out:
            out.write(str(len(found)))
        put(store, found, name)

    monkeypatch.setattr(sinks, "put", told)
    spark.range(400).selectExpr("'k' || id AS slug", "'<p>' || id AS html").coalesce(1).write.parquet(f"{seen}/pages")
    sinks.publish_pages(spark.read.parquet(f"{seen}/pages"), path)
    shares = [int((tmp_path / x).read_text()) for x in os.listdir(seen) if x.startswith("task-")]
    assert sum(shares) == 400 and len(shares) == 4 and min(shares) > 50
    assert written(spark, path) == {f"k{i}": f"<p>{i}" for i in range(400)}


def test_pages_that_went_are_removed_by_all_tasks(spark, tmp_path, monkeypatch):
    path, seen, drop = str(tmp_path / "site"), str(tmp_path), sinks.drop

    def told(store, folders):
        found = list(folders)
        with open(f"{seen}/task-{TaskContext.get().partitionId()}", "w") as out:
            out.write(str(len(found)))
        drop(store, found)

    found = spark.range(400).selectExpr("'k' || id AS slug", "'<p>' || id AS html").coalesce(1)
    sinks.publish_pages(found, path)
    monkeypatch.setattr(sinks, "drop", told)
    sinks.publish_pages(found.where("slug < 'k2'"), path)
    left = {f"k{i}": f"<p>{i}" for i in range(400) if str(i) < "2"}
    shares = [int((tmp_path / x).read_text()) for x in os.listdir(seen) if x.startswith("task-")]
    assert sum(shares) == 400 - len(left) and len(shares) == 4 and min(shares) > 40
    assert written(spark, path) == left


def test_a_changed_page_of_sparks_writer_is_replaced(spark, tmp_path):
    """Sites published before pages had one fixed file."""
    path = str(tmp_path / "site")
    sinks.publish_pages(pages(spark, {"a": "1", "b": "1"}), path)
    os.remove(f"{path}/slug=a/page.txt")
    pages(spark, {"a": "1"}).select("slug", "html").write.mode("append").partitionBy("slug").text(path)
    sinks.publish_pages(pages(spark, {"a": "2", "b": "1"}), path)
    assert os.listdir(f"{path}/slug=a") == ["page.txt"] and written(spark, path) == {"a": "2", "b": "1"}


def test_pages_are_read_by_the_manifest(spark, tmp_path):
    """Whole, with lines and odd keys, without what no manifest names; a page that is missing is an error."""
    path, found = str(tmp_path / "site"), {"a": "two\nlines\n", "c/d e=%": "é", "empty": None, "10": "x", "010": "y"}
    sinks.publish_pages(pages(spark, found), path)
    os.makedirs(f"{path}/slug=other")
    assert {r["slug"]: r["html"] for r in sinks.read_pages(spark, path).collect()} == {k: v or "" for k, v in found.items()}
    os.remove(f"{path}/slug=a/page.txt")
    with pytest.raises(Exception, match="slug=a is empty"):
        sinks.read_pages(spark, path).collect()


def test_folders_are_named_as_by_spark(spark):
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for value in [*map(chr, range(1, 300)), "a b/c=d%[x]^{y}", "日本/é"]:
        assert folder_of("k", value) == f"k={named(value)}"


@pytest.mark.parametrize(("n", "most"), [(0, 10), (1, 10), (10, 10), (11, 10), (2503, 500)])
def test_sitemaps(spark, tmp_path, n, most):
    """Each address once, no file over the bound, all listed by the index, nothing left of the run before."""
    path = str(tmp_path)
    urls = spark.range(n).select(F.concat(F.lit("https://shop.example/?a=1&b=<"), F.col("id") % 10_000).alias("loc"))
    sinks.write_sitemaps(spark.range(60).select(F.concat(F.lit("https://old/"), "id").alias("loc")), path, "https://shop.example", 7)
    files = sinks.write_sitemaps(urls.unionByName(urls).unionByName(spark.createDataFrame([(None,)], "loc string")), path, "https://shop.example", most)
    found = sinks.read_sitemaps(spark, path).collect()
    assert sorted(r["loc"] for r in found) == sorted(r["loc"] for r in urls.collect())
    assert files == -(-n // most) == len([x for x in os.listdir(path) if x.startswith("sitemap-")])
    places = [r["loc"] for r in sorted(found, key=lambda r: (r["file"], r["loc"]))]
    assert places == sorted(places) and all(sum(r["file"] == k for r in found) == min(most, n - k * most) for k in range(files))
    assert not [x for x in os.listdir(path) if x.startswith("_")]


def test_an_index_never_names_files_of_a_run_that_failed(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sinks.write_sitemaps(spark.createDataFrame([("https://a/1",)], "loc string"), path, "https://a")

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(sinks.Files, "replace", fails)
    with pytest.raises(OSError, match="lost"):
        sinks.write_sitemaps(spark.createDataFrame([("https://a/2",)], "loc string"), path, "https://a")
    assert [r["loc"] for r in sinks.read_sitemaps(spark, path).collect()] == ["https://a/1"]
