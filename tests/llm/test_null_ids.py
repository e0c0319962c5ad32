"""Rows without ids are numbered in as many bins as their count asks for."""

from larkspur.llm import sharding


def test_more_null_ids_have_more_bins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BIN", 20)
    monkeypatch.setattr(sharding, "LEAST_NULL_BINS", 2)
    rows = [(None, f"text {i}") for i in range(600)] + [(i, f"own {i}") for i in range(100)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=7).collect()
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == 700 and all(sorted(s) == list(range(100)) for s in by.values()) and len(by) == 7
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == list(range(100))
