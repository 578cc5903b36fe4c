"""The engine's registered queries over the sample tables, and the SQL that each must agree with.

Tables become layers once a session and folder: feature ids are numbered, geometries get envelopes and
a spatial order, as an index build would. Queries then run on the stored layers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import dates, text
from cairnfield.operators import geometry, relations, spatial
from cairnfield.plans.query import Query, build, metrics
from cairnfield.sources.layers import extent_of, extent_of_points, spatially_stored, stored, stored_by_cell, tasks_for, with_fids

_LAYERS: dict[tuple[str, str, str], DataFrame] = {}

#: Unique keys that feature ids follow.
KEYS = {
    "nation": ("n_nationkey",),
    "orders": ("o_orderkey",),
    "customer": ("c_custkey",),
    "part": ("p_partkey",),
    "events": ("event_id",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
}


def _cached(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LAYERS:
        _LAYERS[key] = make()
    return _LAYERS[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with feature ids."""
    return _cached(spark, sf_dir, name, lambda: stored(with_fids(_table(spark, sf_dir, name), *KEYS[name]), name))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points (user_id, value)."""

    def make() -> DataFrame:
        points = layer(spark, sf_dir, "events").withColumn("gbox", spatial.point_envelope(F.col("user_id").cast("double"), F.col("value")))
        return spatially_stored(points, "event-points")

    return _cached(spark, sf_dir, "event_points", make)


def _xy(x: F.Column, y: F.Column) -> F.Column:
    return F.struct(x.alias("x"), y.alias("y"))


def order_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line items (quantity, 100 x discount) as a multipoint or a line, by line number and price."""

    def make() -> DataFrame:
        x, y = F.col("l_quantity"), F.col("l_discount") * 100
        items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice", "l_partkey", "l_quantity", "l_discount")
        extent, rows = extent_of_points(items, x, y)
        partitions = tasks_for(items, rows)
        # dealt out as rows and then collected: arrays begun before the shuffle would hold a task's whole input
        grouped = items.repartition(partitions, "o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", _xy(x, y).alias("p")))).alias("s"))
        parts = grouped.select("o_orderkey", F.array(F.transform("s", lambda s: s["p"])).alias("gparts"))
        return stored_by_cell(parts.withColumn("gbox", spatial.envelope(F.col("gparts"))), "order-shapes", extent, partitions)

    return _cached(spark, sf_dir, "order_shapes", make)


def customer_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with a square hole around each customer's point (custkey mod 1000, account balance / 10)."""

    def ring(half: float, x: F.Column, y: F.Column, turned: bool) -> F.Column:
        corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
        return F.array(*(_xy(x + dx * half, y + dy * half) for dx, dy in (corners[::-1] if turned else corners)))

    def make() -> DataFrame:
        x, y = (F.col("c_custkey") % 1000).cast("double"), F.floor(F.col("c_acctbal") / 10).cast("double")
        squares = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.array(ring(8.0, x, y, False), ring(4.0, x, y, True)).alias("gparts"))
        return spatially_stored(squares.withColumn("gbox", spatial.envelope(F.col("gparts"))), "customer-squares")

    return _cached(spark, sf_dir, "customer_squares", make)


_ORACLE_FID = {name: f"SELECT row_number() OVER (ORDER BY {', '.join(keys)}) - 1 AS fid, * FROM {name}" for name, keys in KEYS.items()}
_ORDER_POINTS = "SELECT l_orderkey AS o_orderkey, l_quantity AS x, l_discount * 100 AS y, l_linenumber, l_extendedprice, l_partkey FROM lineitem"
_SQUARES = "SELECT c_custkey, c_mktsegment, (c_custkey % 1000)::DOUBLE AS x, floor(c_acctbal / 10)::DOUBLE AS y FROM customer"

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run: Run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _where(name: str, table: str, where: str, fields: tuple[str, ...], sql_where: str) -> None:
    """A WHERE query over a table's layer, with feature ids."""
    _register(
        name,
        lambda spark, sf_dir: build(layer(spark, sf_dir, table), Query(fields=fields, where=where)),
        f"SELECT fid, {', '.join(fields)} FROM ({_ORACLE_FID[table]}) t WHERE {sql_where}",
    )


FLAGSHIP = Query(fields=("l_orderkey", "l_quantity", "l_returnflag", "l_discount"), where="l_quantity >= 45 AND (l_returnflag IN ('R','A') OR l_discount != 0.05)", by_fid=True, offset=10, limit=200)
_register(
    "flagship",
    lambda spark, sf_dir: build(layer(spark, sf_dir, "lineitem"), FLAGSHIP),
    f"SELECT fid, l_orderkey, l_quantity, l_returnflag, l_discount FROM ({_ORACLE_FID['lineitem']}) t WHERE l_quantity >= 45 AND (l_returnflag IN ('R','A') OR l_discount IS NULL OR l_discount <> 0.05) ORDER BY fid LIMIT 200 OFFSET 10",
)
_register("scan_all", lambda spark, sf_dir: build(layer(spark, sf_dir, "nation"), Query()).select("fid", "n_nationkey", "n_name", "n_regionkey"), f"SELECT fid, n_nationkey, n_name, n_regionkey FROM ({_ORACLE_FID['nation']}) t")
_register("read_by_fid", lambda spark, sf_dir: build(layer(spark, sf_dir, "orders"), Query(fid=17, fields=("o_orderkey", "o_custkey", "o_totalprice"))), f"SELECT fid, o_orderkey, o_custkey, o_totalprice FROM ({_ORACLE_FID['orders']}) t WHERE fid = 17")
_register("seek_fid", lambda spark, sf_dir: build(layer(spark, sf_dir, "orders"), Query(from_fid=100, by_fid=True, limit=5, fields=("o_orderkey",))), f"SELECT fid, o_orderkey FROM ({_ORACLE_FID['orders']}) t WHERE fid >= 100 ORDER BY fid LIMIT 5")
_register("project", lambda spark, sf_dir: build(_table(spark, sf_dir, "part"), Query(fields=("p_partkey", "p_brand", "p_retailprice"))), "SELECT p_partkey, p_brand, p_retailprice FROM part")

for _name, _op in {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _where(f"where_{_name}", "lineitem", f"l_quantity {_op} 25", ("l_orderkey", "l_quantity"), f"l_quantity {_op} 25")
_where("where_ne", "lineitem", "l_quantity != 25", ("l_orderkey", "l_quantity"), "l_quantity IS NULL OR l_quantity <> 25")
_where("where_string_ge", "part", "p_brand >= 'Brand#3'", ("p_partkey", "p_brand"), "p_brand >= 'Brand#3'")
_where("where_in", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 5)", ("o_orderkey", "o_orderpriority"), "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F')")
_where(
    "where_and_or_paren",
    "lineitem",
    "(l_returnflag = 'R' OR l_linestatus = 'O') AND (l_quantity < 10 OR l_discount >= 0.08)",
    ("l_orderkey", "l_returnflag"),
    "(l_returnflag = 'R' OR l_linestatus = 'O') AND (l_quantity < 10 OR l_discount >= 0.08)",
)
_where("where_precedence", "lineitem", "l_quantity < 3 OR l_quantity > 48 AND l_returnflag = 'N'", ("l_orderkey", "l_quantity"), "l_quantity < 3 OR (l_quantity > 48 AND l_returnflag = 'N')")
_where("where_fraction_of_integer", "part", "p_size > 12.5 AND p_size != 20.5 AND p_size <= 30.75", ("p_partkey", "p_size"), "p_size > 12.5 AND p_size <= 30.75")
_where("where_escaped_quote", "part", "p_name != 'it''s'", ("p_partkey",), "p_name IS NULL OR p_name <> 'it''s'")
_where("where_case_insensitive_field", "part", "P_BRAND = 'Brand#11'", ("p_partkey", "p_brand"), "p_brand = 'Brand#11'")
_where("where_type_mismatch", "customer", "c_name = 5 OR c_acctbal = 'x'", ("c_custkey",), "FALSE")
_where("where_datetime_ole", "orders", "o_orderdate >= 35065 AND o_orderdate < 35430.5", ("o_orderkey", "o_orderdate"), "epoch(o_orderdate) / 86400.0 + 25569 >= 35065 AND epoch(o_orderdate) / 86400.0 + 25569 < 35430.5")
_where("like", "part", "p_name LIKE '%e%_a%'", ("p_partkey", "p_name"), "p_name LIKE '%e%_a%'")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nulls and a NaN column."""
    value = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 11).cast("double")
    return layer(spark, sf_dir, "orders").select("fid", "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), value.alias("v"))


_DERIVED = f"SELECT fid, o_orderkey, nullif(o_orderstatus, 'F') AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 11 END::DOUBLE AS v FROM ({_ORACLE_FID['orders']}) t"
for _name, _clause, _sql in (
    ("where_null_ne", "status != 'O'", "status IS NULL OR status <> 'O'"),
    ("where_null_in", "status IN ('O', 'P') OR v < 2", "status IN ('O', 'P') OR v < 2"),
    ("where_nan_ne", "v != 5", "v IS NULL OR isnan(v) OR v <> 5"),
    ("where_nan_gt", "v > 5", "NOT isnan(v) AND v > 5"),
    ("where_nan_le", "v <= 5", "NOT isnan(v) AND v <= 5"),
    ("is_null", "status IS NULL AND v IS NOT NULL", "status IS NULL AND v IS NOT NULL"),
):
    _register(_name, lambda spark, sf_dir, c=_clause: build(_derived(spark, sf_dir), Query(fields=("o_orderkey", "status"), where=c)), f"SELECT fid, o_orderkey, status FROM ({_DERIVED}) d WHERE {_sql}")

# Boxes: sides of events' points, of order shapes, of customers' squares.
EVENT_BOX = (20.0, 50.0, 90.0, 200.0)
SHAPE_BOX = (10.5, 2.25, 14.5, 4.75)
SQUARE_BOX = (100.0, 300.0, 220.0, 500.0)
HOLE_BOX = (249.0, 199.0, 251.0, 201.0)

_register("bbox_point", lambda spark, sf_dir: build(event_points(spark, sf_dir), Query(fields=("event_id", "user_id", "value"), box=EVENT_BOX, with_geometry=False)), f"SELECT fid, event_id, user_id, value FROM ({_ORACLE_FID['events']}) t WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 200")
_register(
    "bbox_where",
    lambda spark, sf_dir: build(event_points(spark, sf_dir), Query(fields=("event_id", "event_type", "value"), box=EVENT_BOX, where="event_type != 'click' AND value < 150", with_geometry=False)),
    f"SELECT fid, event_id, event_type, value FROM ({_ORACLE_FID['events']}) t WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 200 AND (event_type IS NULL OR event_type <> 'click') AND value < 150",
)
_register("bbox_multipoint", lambda spark, sf_dir: build(order_shapes(spark, sf_dir), Query(fields=("o_orderkey",), box=SHAPE_BOX, with_geometry=False), spatial.MULTIPOINT), f"SELECT o_orderkey FROM ({_ORDER_POINTS}) p GROUP BY o_orderkey HAVING bool_or(x BETWEEN 10.5 AND 14.5 AND y BETWEEN 2.25 AND 4.75)")
_register(
    "bbox_polyline",
    lambda spark, sf_dir: build(order_shapes(spark, sf_dir), Query(fields=("o_orderkey",), box=SHAPE_BOX, with_geometry=False), spatial.LINE),
    f"""
    WITH s AS (SELECT o_orderkey, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({_ORDER_POINTS}) p WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey)),
    c AS (SELECT *, (x2 - x) * (2.25 - y) - (y2 - y) * (10.5 - x) AS a, (x2 - x) * (2.25 - y) - (y2 - y) * (14.5 - x) AS b, (x2 - x) * (4.75 - y) - (y2 - y) * (10.5 - x) AS c, (x2 - x) * (4.75 - y) - (y2 - y) * (14.5 - x) AS d FROM s)
    SELECT DISTINCT o_orderkey FROM c WHERE (x BETWEEN 10.5 AND 14.5 AND y BETWEEN 2.25 AND 4.75)
      OR (x2 IS NOT NULL AND least(x, x2) <= 14.5 AND greatest(x, x2) >= 10.5 AND least(y, y2) <= 4.75 AND greatest(y, y2) >= 2.25
          AND NOT (a > 0 AND b > 0 AND c > 0 AND d > 0) AND NOT (a < 0 AND b < 0 AND c < 0 AND d < 0))""",
)
_HIT = "x - 8 <= {2} AND x + 8 >= {0} AND y - 8 <= {3} AND y + 8 >= {1} AND NOT (x - 4 < {0} AND x + 4 > {2} AND y - 4 < {1} AND y + 4 > {3})"
_register("bbox_polygon", lambda spark, sf_dir: build(customer_squares(spark, sf_dir), Query(fields=("c_custkey",), box=SQUARE_BOX, with_geometry=False), spatial.POLYGON), f"SELECT c_custkey FROM ({_SQUARES}) q WHERE {_HIT.format(*SQUARE_BOX)}")
_register("bbox_polygon_hole", lambda spark, sf_dir: build(customer_squares(spark, sf_dir), Query(fields=("c_custkey",), box=HOLE_BOX, with_geometry=False), spatial.POLYGON), f"SELECT c_custkey FROM ({_SQUARES}) q WHERE {_HIT.format(*HOLE_BOX)}")
_register(
    "bbox_polygon_where",
    lambda spark, sf_dir: build(customer_squares(spark, sf_dir), Query(fields=("c_custkey", "c_mktsegment"), box=SQUARE_BOX, where="c_mktsegment IN ('BUILDING', 'MACHINERY')", with_geometry=False), spatial.POLYGON),
    f"SELECT c_custkey, c_mktsegment FROM ({_SQUARES}) q WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND {_HIT.format(*SQUARE_BOX)}",
)
for _relation, _sql in (
    ("within", "x - 8 >= {0} AND x + 8 <= {2} AND y - 8 >= {1} AND y + 8 <= {3}"),
    ("disjoint", f"NOT ({_HIT})"),
):
    _register(
        f"relation_{_relation}",
        lambda spark, sf_dir, r=_relation: customer_squares(spark, sf_dir).where(spatial.relation(spatial.POLYGON, r, spatial.Box(*SQUARE_BOX), F.col("gbox"), F.col("gparts"))).select("c_custkey"),
        f"SELECT c_custkey FROM ({_SQUARES}) q WHERE {_sql.format(*SQUARE_BOX)}",
    )
_register(
    "bbox_metrics",
    lambda spark, sf_dir: metrics(customer_squares(spark, sf_dir), Query(box=SQUARE_BOX), spatial.POLYGON),
    f"""SELECT count(*) FILTER (WHERE m) AS candidates, count(*) FILTER (WHERE NOT m) AS rejected, count(*) FILTER (WHERE i) AS contained, count(*) FILTER (WHERE m AND NOT i) AS tested, count(*) FILTER (WHERE h) AS matched, 0::BIGINT AS invalid
    FROM (SELECT x - 8 <= 220 AND x + 8 >= 100 AND y - 8 <= 500 AND y + 8 >= 300 AS m, x - 8 >= 100 AND x + 8 <= 220 AND y - 8 >= 300 AND y + 8 <= 500 AS i, {_HIT.format(*SQUARE_BOX)} AS h FROM ({_SQUARES}) q) z""",
)
_register(
    "fid_intersect",
    lambda spark, sf_dir: relations.common_fids(build(event_points(spark, sf_dir), Query(box=EVENT_BOX)), build(layer(spark, sf_dir, "events"), Query(where="event_type = 'purchase'"))),
    f"SELECT fid FROM ({_ORACLE_FID['events']}) t WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 200 INTERSECT SELECT fid FROM ({_ORACLE_FID['events']}) u WHERE event_type = 'purchase'",
)
_register(
    "candidate_rows",
    lambda spark, sf_dir: relations.rows_of_candidates(layer(spark, sf_dir, "events"), build(event_points(spark, sf_dir), Query(box=EVENT_BOX))).select("fid", "event_type"),
    f"SELECT fid, event_type FROM ({_ORACLE_FID['events']}) t WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 200",
)
_register("order_offset_limit", lambda spark, sf_dir: build(layer(spark, sf_dir, "orders"), Query(fields=("o_orderkey",), where="o_totalprice > 100000", by_fid=True, offset=20, limit=50)), f"SELECT fid, o_orderkey FROM ({_ORACLE_FID['orders']}) t WHERE o_totalprice > 100000 ORDER BY fid LIMIT 50 OFFSET 20")
_register("offset_past_end", lambda spark, sf_dir: build(layer(spark, sf_dir, "nation"), Query(fields=("n_name",), by_fid=True, offset=1000)), f"SELECT fid, n_name FROM ({_ORACLE_FID['nation']}) t ORDER BY fid OFFSET 1000")
_register("count_all", lambda spark, sf_dir: _table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
_register("count_filtered", lambda spark, sf_dir: build(event_points(spark, sf_dir), Query(box=EVENT_BOX, where="value >= 100")).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM events WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 200 AND value >= 100")
_register("extent", lambda spark, sf_dir: relations.extent(event_points(spark, sf_dir)), "SELECT min(user_id)::DOUBLE AS xmin, min(value) AS ymin, max(user_id)::DOUBLE AS xmax, max(value) AS ymax FROM events")
_register("extent_polygons", lambda spark, sf_dir: relations.extent(customer_squares(spark, sf_dir)), f"SELECT min(x) - 8 AS xmin, min(y) - 8 AS ymin, max(x) + 8 AS xmax, max(y) + 8 AS ymax FROM ({_SQUARES}) q")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extent_of(event_points(spark, sf_dir))
    share = 0.0 if found is None else spatial.coverage(spatial.Box(*EVENT_BOX), found)
    return spark.range(1).select(F.round(F.lit(share), 9).alias("coverage"))


_register("coverage", _coverage, "SELECT round(greatest(0, least(90, max(user_id)) - greatest(20, min(user_id))) * greatest(0, least(200, max(value)) - greatest(50, min(value))) / ((max(user_id) - min(user_id)) * (max(value) - min(value))), 9) AS coverage FROM events")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat(F.lit("\\"), "r_name", F.lit("\\"), "n_name").alias("path"))


_register("group_members", lambda spark, sf_dir: relations.group_members(_paths(spark, sf_dir)), "SELECT '/' || r_name AS parent, string_agg(n_name, ',' ORDER BY n_name) AS members, count(*) AS n_members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as relationships: type by priority, from a customer to a nation (some ends missing)."""
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rel = orders.select(F.col("o_orderkey").cast("string").alias("uuid"), F.upper("o_orderpriority").alias("type"), F.concat(F.lit("C"), "o_custkey").alias("origin_id"), F.concat(F.lit("n"), F.col("o_custkey") % 30).alias("dest_id"))
    types = orders.select(F.lower("o_orderpriority").alias("uuid"), F.concat(F.lit("type "), "o_orderpriority").alias("name"), F.col("o_orderkey").alias("fid")).where("uuid not like '5%'")
    items = customer.select(F.concat(F.lit("c"), "c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.concat(F.lit("/"), "c_name").alias("path"), F.col("c_custkey").alias("fid"))
    items = items.union(nation.select(F.concat(F.lit("N"), "n_nationkey"), "n_name", F.concat(F.lit("/"), "n_name"), F.col("n_nationkey").cast("long")))
    return relations.relationship_summary(rel, types, items)


_register(
    "relationship_summary",
    _relationships,
    """SELECT o_orderkey::VARCHAR AS uuid, CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE 'type ' || o_orderpriority END AS type_name, coalesce(c_name, '') AS origin_name, coalesce('/' || c_name, '') AS origin_path,
    coalesce(n_name, '') AS dest_name, coalesce('/' || n_name, '') AS dest_path FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 30""",
)


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _table(spark, sf_dir, "part").select(F.lit("part").alias("table"), F.col("p_partkey").cast("string").alias("field"), F.upper("p_brand").alias("domain"))
    domains = _table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name"), F.lit("coded").alias("type")).distinct().where("name <> 'brand#11'")
    return relations.field_domains(fields, domains)


_register("field_domains", _domains, "SELECT 'part' AS \"table\", p_partkey::VARCHAR AS field, upper(p_brand) AS domain, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE 'coded' END AS domain_type FROM part")
_register("distinct_fids", lambda spark, sf_dir: relations.distinct_fids(layer(spark, sf_dir, "orders").select(F.floor(F.col("fid") / 3).alias("fid"))), f"SELECT DISTINCT fid // 3 AS fid FROM ({_ORACLE_FID['orders']}) t")
_register(
    "table_digest",
    lambda spark, sf_dir: relations.table_digest(_table(spark, sf_dir, "nation")).select("n_rows", F.col("digest").cast("string").alias("digest")),
    "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws(chr(31), n_name, n_nationkey::VARCHAR, n_regionkey::VARCHAR)), 1, 12))::BIGINT)::VARCHAR AS digest FROM nation",
)
_register("inventory", lambda spark, sf_dir: relations.inventory(_table(spark, sf_dir, "events").select(F.col("event_type").alias("ext"), F.col("user_id").alias("size"))), "SELECT event_type AS ext, count(*) AS n_files, sum(user_id)::BIGINT AS n_bytes FROM events GROUP BY event_type")
_register("cell_id", lambda spark, sf_dir: _table(spark, sf_dir, "events").select("event_id", text.cell_id(F.col("user_id").cast("double"), 8.0).alias("cell_x"), text.cell_id(F.col("value"), 12.5).alias("cell_y")), "SELECT event_id, floor(user_id / 8.0)::BIGINT + 536870912 AS cell_x, floor(value / 12.5)::BIGINT + 536870912 AS cell_y FROM events")
_register("cell_candidates", lambda spark, sf_dir: _table(spark, sf_dir, "events").select(text.cell_id(F.col("user_id").cast("double"), 8.0).alias("cx"), "event_id").where("cx between 536870914 and 536870920").select("event_id").distinct(), "SELECT DISTINCT event_id FROM events WHERE floor(user_id / 8.0) BETWEEN 2 AND 8")
_register("ole_double", lambda spark, sf_dir: (lambda o: o.select("o_orderkey", F.round(dates.ole_double(F.col("o_orderdate"), o.schema["o_orderdate"].dataType), 9).alias("ole")))(_table(spark, sf_dir, "orders")), "SELECT o_orderkey, round(epoch(o_orderdate) / 86400.0 + 25569, 9) AS ole FROM orders")
_register(
    "ole_text",
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", *(dates.ole_text((F.col("o_orderkey") % 60000).cast("double") + 0.25, p).alias(f"ole_{p}") for p in ("datetime", "date", "time"))),
    "WITH t AS (SELECT o_orderkey, TIMESTAMP '1899-12-30 06:00:00' + to_days((o_orderkey % 60000)::INTEGER) AS ts FROM orders) SELECT o_orderkey, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ole_datetime, strftime(ts, '%Y-%m-%d') AS ole_date, strftime(ts, '%H:%M:%S') AS ole_time FROM t",
)
_register("paths", lambda spark, sf_dir: _paths(spark, sf_dir).select(text.canonical_path(F.col("path")).alias("path"), text.parent_path(F.col("path")).alias("parent"), text.leaf_name(F.col("path")).alias("leaf")), "SELECT '/' || r_name || '/' || n_name AS path, '/' || r_name AS parent, n_name AS leaf FROM nation JOIN region ON n_regionkey = r_regionkey")
_register("uuid_text", lambda spark, sf_dir: _table(spark, sf_dir, "part").select("p_partkey", text.uuid_text(F.unhex(F.md5(F.col("p_partkey").cast("string")))).alias("uuid")), "WITH t AS (SELECT p_partkey, md5(p_partkey::VARCHAR) AS h FROM part) SELECT p_partkey, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] AS uuid FROM t")
_register("sql_quote", lambda spark, sf_dir: _table(spark, sf_dir, "customer").select("c_custkey", text.quoted(F.concat("c_name", F.lit("'s"))).alias("quoted")), "SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS quoted FROM customer")
_register("xml_tags", lambda spark, sf_dir: _table(spark, sf_dir, "nation").select("n_nationkey", text.tag_text(F.concat(F.lit("<A kind=\"x\"><Name> "), "n_name", F.lit(" </Name><Name>z</Name></A>")), "Name").alias("name")), "SELECT n_nationkey, n_name AS name FROM nation")
_register("utf16_text", lambda spark, sf_dir: _table(spark, sf_dir, "nation").select("n_nationkey", text.utf16_text(F.encode(F.concat("n_name", F.lit("é\U0001f600\x00rest")), "UTF-16LE")).alias("name")), "SELECT n_nationkey, n_name || 'é😀' AS name FROM nation")
_register("grid_coordinates", lambda spark, sf_dir: _table(spark, sf_dir, "events").select("event_id", text.real_to_grid(F.col("user_id") + 0.125, -400.0, 1000.0).alias("grid"), text.grid_to_real(F.col("user_id"), -400.0, 8.0).alias("real")), "SELECT event_id, round((user_id + 0.125 + 400) * 1000)::BIGINT AS grid, user_id / 8.0 - 400 AS real FROM events")
_register("ring_area", lambda spark, sf_dir: customer_squares(spark, sf_dir).select("c_custkey", spatial.signed_area(F.col("gparts")[0]).alias("outer_area"), spatial.signed_area(F.col("gparts")[1]).alias("hole_area")), "SELECT c_custkey, 256.0::DOUBLE AS outer_area, -64.0::DOUBLE AS hole_area FROM customer")
def _point_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_points(spark, sf_dir).select("event_id", geometry.point_wkb(F.floor(F.col("gbox.xmin")), F.floor(F.col("gbox.ymin"))).alias("wkb"))
    return geometry.with_wkt(points).select("event_id", F.length("wkb").alias("n_bytes"), "wkt")


_register("point_wkb", _point_wkt, "SELECT event_id, 21 AS n_bytes, 'POINT (' || user_id || ' ' || floor(value)::BIGINT || ')' AS wkt FROM events")
_register(
    "polygon_wkb",
    lambda spark, sf_dir: geometry.with_wkb(customer_squares(spark, sf_dir).select("c_custkey", "gparts"), spatial.POLYGON).select("c_custkey", F.lower(F.hex("wkb")).alias("wkb")),
    f"""WITH corners AS (SELECT c_custkey, unnest([x-8, x+8, x+8, x-8, x-8, x-4, x+4, x+4, x-4, x-4])::BIGINT AS px, unnest([y-8, y-8, y+8, y+8, y-8, y+4, y+4, y-4, y-4, y+4])::BIGINT AS py, unnest(range(10)) AS k FROM ({_SQUARES}) q),
    v AS (SELECT DISTINCT px AS n FROM corners UNION SELECT DISTINCT py FROM corners),
    e AS (SELECT n, CASE WHEN n = 0 THEN 0 ELSE floor(log2(abs(n)))::INTEGER END AS e FROM v),
    b AS (SELECT n, CASE WHEN n = 0 THEN repeat('0', 16) ELSE lpad(to_hex((((1023 + e)::BIGINT << 52) | ((abs(n) - (1::BIGINT << e)) << (52 - e)))::BIGINT), 16, '0') END AS h FROM e),
    d AS (SELECT n, lower((CASE WHEN n < 0 THEN to_hex((('0x' || h[1:1])::BIGINT) + 8) || h[2:] ELSE h END)) AS h FROM b),
    l AS (SELECT n, h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS h FROM d)
    SELECT c_custkey, '0106000000010000000103000000020000000500' || '0000' || string_agg(CASE WHEN k = 5 THEN '05000000' ELSE '' END || a.h || o.h, '' ORDER BY k) AS wkb FROM corners JOIN l a ON a.n = px JOIN l o ON o.n = py GROUP BY c_custkey""",
)
_register("polygon_wkt", lambda spark, sf_dir: geometry.with_wkt(geometry.with_wkb(customer_squares(spark, sf_dir).select("c_custkey", "gparts"), spatial.POLYGON)).select("c_custkey", "wkt"), f"""
    WITH q AS ({_SQUARES}), s AS (SELECT c_custkey, x::BIGINT AS x, y::BIGINT AS y FROM q)
    SELECT c_custkey, 'MULTIPOLYGON (((' || (x-8) || ' ' || (y-8) || ', ' || (x+8) || ' ' || (y-8) || ', ' || (x+8) || ' ' || (y+8) || ', ' || (x-8) || ' ' || (y+8) || ', ' || (x-8) || ' ' || (y-8)
        || '), (' || (x-4) || ' ' || (y+4) || ', ' || (x+4) || ' ' || (y+4) || ', ' || (x+4) || ' ' || (y-4) || ', ' || (x-4) || ' ' || (y-4) || ', ' || (x-4) || ' ' || (y+4) || ')))' AS wkt FROM s""")

_register(
    "ole_before_epoch",
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", dates.ole_text(-(F.col("o_orderkey") % 2000).cast("double") - 1, "date").alias("day")),
    "SELECT o_orderkey, strftime(TIMESTAMP '1899-12-30 00:00:00' - to_days((o_orderkey % 2000)::INTEGER + 1), '%Y-%m-%d') AS day FROM orders",
)
_register("offset_minutes", lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", dates.offset_minutes(F.col("o_orderkey") % 256).cast("long").alias("minutes")), "SELECT o_orderkey, CASE WHEN o_orderkey % 256 BETWEEN 2 AND 198 THEN (o_orderkey % 256 - 100) * 15 ELSE 0 END AS minutes FROM orders")
