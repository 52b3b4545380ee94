"""Written intermediate tables."""

from pathlib import Path
from urllib.parse import urlparse

from tracewell.functions.storage import materialize, scratch, shared_dir


def test_scratch_is_removed(spark):
    with scratch(spark) as folder:
        assert folder.startswith(shared_dir(spark))
        table = materialize(spark.range(3), "numbers")
        assert sorted(r.id for r in table.collect()) == [0, 1, 2] and all(folder in f for f in table.inputFiles())
        assert Path(urlparse(folder).path).exists()
    assert not Path(urlparse(folder).path).exists()
    outside = materialize(spark.range(1), "numbers")
    assert all(folder not in f for f in outside.inputFiles()) and outside.count() == 1


def test_partitioned_tables_read_what_they_need(spark):
    table = materialize(spark.range(9).selectExpr("id", "id % 3 AS block"), "numbers", partition_by="block")
    part = table.where("block = 1")
    assert sorted(r.id for r in part.collect()) == [1, 4, 7]
    assert "PartitionFilters: [isnotnull(block" in part._jdf.queryExecution().toString()
