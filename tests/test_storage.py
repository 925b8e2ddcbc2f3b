"""Intermediate tables: written once, noted, deleted on request."""

from pathlib import Path

from faultline.sources.storage import discard, materialized


def test_noted_tables_are_deleted(spark):
    folder, scratch = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")), []
    before = set(folder.iterdir())
    kept = materialized(spark.range(3))
    other = materialized(spark.range(5), scratch)
    assert other.count() == 5 and len(scratch) == 1
    discard(spark, scratch)
    assert scratch == [] and len(set(folder.iterdir()) - before) == 1
    assert kept.count() == 3
