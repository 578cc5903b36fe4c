"""Counts, extents, groups, digests and the joins of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.text import leaf_name, parent_path


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the first in order (of equal ones the least in the other columns); nulls are no key.

    Minima are combined before the shuffle, so a key of very many rows is one row a task.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    least = F.min(F.struct(order, *rest)).alias("_least") if order != key else F.min(F.struct(*rest)).alias("_least")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(least).select(key, *([f"_least.{order}"] if order != key else []), *(f"_least.{c}" for c in rest))


def _keyed(df: DataFrame, key: str, order: str, prefix: str, keep: dict[str, str]) -> DataFrame:
    keyed = df.select(F.lower(key).alias(f"{prefix}_key"), F.col(order).alias("_order"), *(F.col(c).alias(f"{prefix}_{as_}") for c, as_ in keep.items()))
    return first_of_each(keyed, f"{prefix}_key", "_order").drop("_order")


def relationship_summary(relationships: DataFrame, types: DataFrame, items: DataFrame, order: str = "fid") -> DataFrame:
    """Each relationship with its type and the names and paths of both ends; missing ends are blank.

    relationships: uuid, type, origin_id, dest_id; types: uuid, name; items: uuid, name, path. Ids match in
    any case; of equal ids the first counts. The planner broadcasts what is small enough.
    """
    kinds = _keyed(types, "uuid", order, "t", {"name": "name"})
    ends = {"origin_id": "o", "dest_id": "d"}
    out = relationships.join(kinds, F.lower(relationships["type"]) == kinds["t_key"], "left")
    for column, prefix in ends.items():
        side = _keyed(items, "uuid", order, prefix, {"name": "name", "path": "path"})
        out = out.join(side, F.lower(relationships[column]) == side[f"{prefix}_key"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        relationships["uuid"], blank("t_name").alias("type_name"), blank("o_name").alias("origin_name"), blank("o_path").alias("origin_path"), blank("d_name").alias("dest_name"), blank("d_path").alias("dest_path")
    )


def field_domains(fields: DataFrame, domains: DataFrame, order: str = "domain") -> DataFrame:
    """fields (table, field, domain) with the domain's type, null where no domain has the name."""
    keyed = first_of_each(domains.select(F.lower("name").alias("_key"), F.col("type").alias("domain_type"), F.col("name").alias("domain_name")), "_key", "domain_name")
    return fields.join(keyed, F.lower(fields["domain"]) == keyed["_key"], "left").select("table", "field", "domain", "domain_type")


def index_fields(indexes: DataFrame, fields: DataFrame) -> DataFrame:
    """Indexes whose expression is a field's name, in any case."""
    return indexes.join(fields, F.lower(indexes["expression"]) == F.lower(fields["field"])).select(indexes["index"], fields["field"])


def group_members(items: DataFrame) -> DataFrame:
    """parent, members (sorted names, comma-separated) and their number; items: path."""
    named = items.select(parent_path(F.col("path")).alias("parent"), leaf_name(F.col("path")).alias("name"))
    return named.groupBy("parent").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("members"), F.count(F.lit(1)).alias("n_members"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows and a digest that the order of rows and columns does not change."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *text)), 1, 12), 16, 10).cast("long")
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def audit(tables: dict[str, DataFrame | None]) -> DataFrame | None:
    """name, status (ok, empty, missing), n_rows and digest of each table."""
    out, spark = None, None
    for name, df in sorted(tables.items()):
        if df is not None:
            spark = df.sparkSession
            part = table_digest(df).select(F.lit(name).alias("name"), F.when(F.col("n_rows") > 0, "ok").otherwise("empty").alias("status"), "n_rows", "digest")
            out = part if out is None else out.unionByName(part)
    missing = [name for name, df in tables.items() if df is None]
    if missing and spark is not None:
        gone = spark.createDataFrame([(m, "missing", 0) for m in sorted(missing)], "name string, status string, n_rows long").withColumn("digest", F.lit(None).cast("decimal(38,0)"))
        out = gone if out is None else out.unionByName(gone)
    return out


def inventory(files: DataFrame) -> DataFrame:
    """Files by extension: number and bytes; files: ext, size."""
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def extent(df: DataFrame, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """One row: the envelope of all geometries (of gbox, or of point coordinates)."""
    low_x, high_x = (x, x) if x is not None else (F.col("gbox.xmin"), F.col("gbox.xmax"))
    low_y, high_y = (y, y) if y is not None else (F.col("gbox.ymin"), F.col("gbox.ymax"))
    return df.agg(F.min(low_x).alias("xmin"), F.min(low_y).alias("ymin"), F.max(high_x).alias("xmax"), F.max(high_y).alias("ymax"))


def common_fids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Feature ids of both, each once."""
    return left.select("fid").intersect(right.select("fid"))


def rows_of_candidates(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows whose feature id is a candidate."""
    return df.join(candidates.select("fid"), "fid", "left_semi")


def distinct_fids(df: DataFrame) -> DataFrame:
    return df.select("fid").distinct()
