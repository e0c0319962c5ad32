"""Writes to one folder add up; one that fails changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.llm import warc


def pages(spark, ids):
    return warc.archive(spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 40) for i in ids], "page_id long, url string, html string").repartition(3))


def ids(spark, path):
    return sorted(r[0] for r in warc.read(spark, path).select(warc.key_of(F.col("record_id"))).collect())


def test_all_writes_to_a_path_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    for k in range(3):
        warc.write(pages(spark, range(5 * k, 5 * k + 5)), path)
        assert ids(spark, path) == list(range(5 * k + 5))
    warc.write(pages(spark, []), path)
    assert ids(spark, path) == list(range(15))


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(pages(spark, range(5)), path)
    bad = pages(spark, range(5, 9)).withColumn("target_uri", F.when(F.col("record_id") == "urn:page:7", F.raise_error(F.lit("no"))).otherwise(F.col("target_uri")))
    with pytest.raises(Exception, match="no"):
        warc.write(bad, path)
    assert ids(spark, path) == list(range(5))


def test_archives_without_a_list_stay_readable(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(pages(spark, range(5)), path)
    for name in os.listdir(tmp_path / "a"):
        if name.endswith(".json"):
            os.remove(tmp_path / "a" / name)
    warc.write(pages(spark, range(5, 8)), path)
    assert ids(spark, path) == list(range(8))


def test_overwriting_removes_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(pages(spark, range(5)), path)
    warc.write(pages(spark, range(5, 7)), path)
    pages(spark, range(20, 23)).write.format("warc").mode("overwrite").save(path)
    assert ids(spark, path) == [20, 21, 22]
    left = os.listdir(tmp_path / "a")
    assert sum(n.endswith(".json") for n in left) == 1 and sum(n.endswith(".warc.gz") for n in left) <= 3
