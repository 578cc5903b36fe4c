"""Layers stored as Parquet: feature ids, envelopes and an order of rows that lets scans skip."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import spatial

_LOCAL: dict[str, str] = {}

#: Rows of a task in memory, about, so that a sort needs no disk however large the table and few spark.sql.shuffle.partitions are.
TASK_BYTES = 64 << 20
#: Of Parquet that a task reads before it deals rows out; rows in memory take some fourteen times as much.
SPLIT_BYTES = 8 << 20
#: Of a point in gparts, about.
POINT_BYTES = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a machine's own one only where that machine is all there is."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="cairnfield-layers-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int, points: int = 0) -> int:
    """Partitions for so many rows of df, which hold so many points."""
    size = rows * (df._jdf.schema().defaultSize() + 8 * len(df.columns)) + points * POINT_BYTES
    return max(1, -(-size // TASK_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, -(-size // (TASK_BYTES // 16))))


@contextlib.contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that start here read SPLIT_BYTES a task at most, as writers of a shuffle hold what a task has read."""
    key = "spark.sql.files.maxPartitionBytes"
    before, now = spark.conf.get(key, None), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(key, str(min(now, SPLIT_BYTES)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dealt(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """df by ranges of keys, shuffled here and once: all that is read from the result sees the same ranges, which Spark would else draw anew."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions, *keys)
    with small_splits(spark):
        rows = ranged._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, ranged._jdf.schema(), False), spark)


def with_fids(df: DataFrame, *keys: str) -> DataFrame:
    """Adds zero-based `fid` in the order of keys, which are unique.

    Rows are range-partitioned and counted, one number a partition, then sorted and numbered inside each
    partition from where the ones before it end. No window over all rows, and no copy of them but the shuffle's.
    """
    ranges, part = dealt(df, tasks_for(df, df.count()), *keys), F.spark_partition_id()
    sizes = dict(ranges.groupBy(part.alias("_part")).agg(F.count(F.lit(1))).collect())  # one row a partition
    starts = accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=0)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return ranges.sortWithinPartitions(*keys).withColumn("fid", F.array(*(F.lit(n).cast("long") for n in starts))[part] + place)


def spread_bits(value: Column) -> Column:
    """16 bits, each followed by a zero."""
    out = value
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = (out.bitwiseOR(F.shiftleft(out, shift))).bitwiseAND(mask)
    return out


def cell_order(gbox: Column, extent: spatial.Box) -> Column:
    """Place of the envelope's centre on a Z-shaped curve over the extent; rows near in space are near in the file."""

    def level(low: Column, high: Column, start: float, end: float) -> Column:
        part = ((low + high) / 2 - start) / (end - start if end > start else 1.0)
        return F.least(F.lit(65535), F.greatest(F.lit(0), F.floor(part * 65535))).cast("long")

    x = level(gbox["xmin"], gbox["xmax"], extent.xmin, extent.xmax)
    y = level(gbox["ymin"], gbox["ymax"], extent.ymin, extent.ymax)
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1))


def _sides(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> list[Column]:
    return [F.min(xmin).alias("a"), F.min(ymin).alias("b"), F.max(xmax).alias("c"), F.max(ymax).alias("d")]


def extent_of(df: DataFrame) -> spatial.Box | None:
    """The layer's extent, None without geometry."""
    return _surveyed(df)[0]


def _surveyed(df: DataFrame, *more: Column) -> tuple[spatial.Box | None, list[int]]:
    row = df.agg(*_sides(*(F.col(f"gbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))), *more).first()
    return None if row["a"] is None else spatial.Box(*row[:4]), [n or 0 for n in row[4:]]


def extent_of_points(df: DataFrame, x: Column, y: Column) -> tuple[spatial.Box | None, int]:
    """The extent of whatever geometries are made of these points, and how many there are."""
    row = df.agg(*_sides(x, y, x, y), F.count(F.lit(1)).alias("n")).first()
    return None if row["a"] is None else spatial.Box(*row[:4]), row["n"]


def spatially_stored(df: DataFrame, label: str) -> DataFrame:
    """df with `gbox`, stored in the order of cells."""
    points = F.sum(F.aggregate("gparts", F.lit(0), lambda n, part: n + F.size(part))) if "gparts" in df.columns else F.lit(0)
    extent, (rows, held) = _surveyed(df, F.count(F.lit(1)), points)
    return stored_by_cell(df, label, extent, tasks_for(df, rows, held))


def stored_by_cell(df: DataFrame, label: str, extent: spatial.Box | None, partitions: int) -> DataFrame:
    """The same where extent and partitions are known, so df is not computed for them."""
    with small_splits(df.sparkSession):
        if extent is None:
            return stored(df, label)
        ordered = df.withColumn("_cell", F.coalesce(cell_order(F.col("gbox"), extent), F.lit(-1)))
        return stored(ordered.repartitionByRange(partitions, "_cell").sortWithinPartitions("_cell").drop("_cell"), label)
