"""Shared helpers of the training-data operators.

Conventions that hold for every operator in this subpackage:

* only the named columns are read, so extra columns, whatever their names, are ignored;
* a null text counts as an empty text unless the operator says otherwise;
* repeated rows are rows of their own and are all returned;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: A-Z to a-z and nothing else, for bytes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a machine's own one only where that machine is all there is."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="cairnfield-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{re.sub(r'[^A-Za-z0-9_-]', '_', label)}-{uuid.uuid4().hex[:12]}"


def _discard(jvm, path: str) -> None:
    """Removes a folder of the shared file system; at the end of the driver, when the file system may be gone already."""
    with contextlib.suppress(Exception):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


#: Spark 4.1 and later then remove the shuffle files of a statement at its end; else they stay until the driver collects its garbage.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, last_use: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and a lost executor loses nothing. The files go when the driver ends, or by `discard`.

    last_use: the shuffle files of this write go at its end.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    atexit.register(_discard, spark._jvm, path)
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    if last_use:
        spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if last_use and before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        elif last_use:
            spark.conf.set(_REMOVE_SHUFFLES, before)
    held = spark.read.schema(df.schema).parquet(path)
    held._cairnfield_path = path
    return held


def discard(*frames: DataFrame) -> None:
    """Removes the files of frames that `cut` gave; nothing may read them any more."""
    for df in frames:
        _discard(df.sparkSession._jvm, df._cairnfield_path)


def rows_with_bits(rows: DataFrame, chosen: DataFrame, id_col: str, or_where: Column | None = None) -> DataFrame:
    """The rows whose row id (of monotonically_increasing_id, as written out) is among chosen, or that are as or_where says.

    A bit for each row id goes to every worker, 4 KB for 32,768 ids that follow one another; the rows themselves are not shuffled.
    """
    width, columns = 1 << 15, rows.columns
    chunk, place = F.shiftright(id_col, 15), F.col(id_col).bitwiseAND(width - 1)
    bits = chosen.select(chunk.alias("__cf_chunk"), place.alias("__cf_place")).repartition("__cf_chunk").groupBy("__cf_chunk").agg(F.bitmap_construct_agg("__cf_place").alias("__cf_bits"))
    byte = F.conv(F.hex(F.substring("__cf_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(bits), chunk == F.col("__cf_chunk"), "inner" if or_where is None else "left")
    return joined.where(held if or_where is None else held | or_where).select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def as_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes, empty where it is null; Python workers then need not decode."""
    return F.coalesce(text.cast("binary"), F.lit(b""))
