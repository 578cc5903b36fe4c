"""What storing a layer costs: how often rows are written and shuffled, and how many a task gets."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cairnfield import queries as engine
from cairnfield.operators import spatial
from cairnfield.sources import layers
from tests.conftest import SF_SMALL


@pytest.fixture
def fresh(monkeypatch):
    """Layers are made anew."""
    monkeypatch.setattr(engine, "_LAYERS", {})


def _folders(spark) -> set[str]:
    return {name.rpartition("-")[0] + "-" + name for name in os.listdir(layers.shared_dir(spark).removeprefix("file://"))}


def test_numbering_deals_by_rows_and_writes_none(spark, monkeypatch):
    monkeypatch.setattr(layers, "TASK_BYTES", 1 << 15, raising=False)
    before, splits = _folders(spark), spark.conf.get("spark.sql.files.maxPartitionBytes", None)
    df = spark.range(8000).selectExpr("case when id = 5 then null else (id * 7919) % 8000 end as k", "id")
    held = layers.with_fids(df, "k", "id")
    per_task = held.rdd.glom().map(len).collect()
    assert len(per_task) >= 8 and max(per_task) < 2000
    rows = [(r.fid, r.k) for r in held.orderBy("fid").collect()]
    assert [r[0] for r in rows] == list(range(8000))
    assert [r[1] for r in rows] == [None, *(k for k in range(8000) if k != 5 * 7919 % 8000)]
    assert held.where("fid = 17").count() == 1
    assert _folders(spark) == before
    assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) == splits


def test_where_writes_its_layer_once(spark, fresh):
    before = _folders(spark)
    assert engine.QUERIES["where_eq"](spark, SF_SMALL).count() > 0
    assert [f.partition("-")[0] for f in _folders(spark) - before] == ["lineitem"]


def test_order_shapes_shuffle_line_items_once_and_shapes_once(spark, fresh):
    sc = spark.sparkContext
    orders = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey").distinct().count()
    sc.setJobGroup("shapes", "shapes")
    try:
        shapes = engine.order_shapes(spark, SF_SMALL)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    ran = {s for j in tracker.getJobIdsForGroup("shapes") for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() >= orders for s in ran) == 2
    assert shapes.count() == orders


def test_known_extent_is_that_of_the_shapes(spark):
    rows = [(1, 1.0, 2.0), (1, None, 9.0), (2, -3.0, None), (2, None, None), (None, 4.0, 5.0)]
    points = spark.createDataFrame(rows, "k long, x double, y double")
    shapes = points.groupBy("k").agg(F.array(F.collect_list(F.struct("x", "y"))).alias("gparts"))
    extent, n = layers.extent_of_points(points, F.col("x"), F.col("y"))
    assert n == len(rows) and extent == layers.extent_of(shapes.withColumn("gbox", spatial.envelope(F.col("gparts"))))
