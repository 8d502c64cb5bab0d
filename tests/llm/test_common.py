"""Shelves and Arrow limits."""

import os
from types import SimpleNamespace

import pytest

from tessera.llm import common, registry


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: folder))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shelf_root(session(master))
        assert common.shelf_root(session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert common.shelf_root(session("local[4]")).startswith("file:/")


def test_shelves_go(spark):
    df = common.shelve(spark.range(5))
    path = df._shelf.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 5
    common.unshelve(df)
    assert not os.path.exists(path)


def test_arrow_limits_are_the_same_whichever_operator_ran(spark, sf):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    seen = set()
    for name in ("op2_warc_round_trip", "op8_media_columns", "op7_bpe_round_trip"):
        registry.QUERIES[name](spark, sf).count()
        seen.add(tuple(spark.conf.get(k) for k in keys))
    assert seen == {(str(common.ARROW_ROWS), str(common.ARROW_BYTES))}


def test_sizes_as_spark_writes_them():
    assert [common._bytes(x) for x in ("64MB", "256m", "1g", "-1", "1000", "none")] == [64 << 20, 256 << 20, 1 << 30, -1, 1000, -1]
