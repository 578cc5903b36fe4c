"""Registered queries over a geodatabase directory that is written from the sample tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.catalog import Dataset, Layer
from cairnfield.functions import dates
from cairnfield.operators import geometry, relations, spatial
from cairnfield.plans.query import Query
from cairnfield.sources import filegdb, metadata
from cairnfield.sources.layers import shared_dir
from cairnfield.sources.writer import TableWriter, blob, write_geodatabase

_SAMPLES: dict[tuple[str, str], Dataset] = {}
_ID = ("OBJECTID", filegdb.OBJECTID, False)


def _ring(x: float, y: float, half: float, turned: bool) -> list[tuple[float, float]]:
    corners = [(x - half, y - half), (x - half, y + half), (x + half, y + half), (x + half, y - half), (x - half, y - half)]
    return corners[::-1] if turned else corners


def _domain(name: str, codes: list[str]) -> str:
    listed = "".join(f"<CodedValue xsi:type='typens:CodedValue'><Name>{c.lower()}</Name><Code>{c}</Code></CodedValue>" for c in codes)
    return f"<GPCodedValueDomain2 xsi:type='typens:GPCodedValueDomain2'><DomainName>{name}</DomainName><FieldType>esriFieldTypeString</FieldType><CodedValues>{listed}</CodedValues></GPCodedValueDomain2>"


def sample(spark: SparkSession, sf_dir: str) -> Dataset:
    """orders_t (no geometry, deleted ids), nations (points), squares (polygons with holes), paths (lines), clusters (multipoints) and items, of at most 3,000 rows a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _SAMPLES:
        return _SAMPLES[key]
    read = lambda name, *order: spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy(*order).limit(3000).collect()  # noqa: E731  # the sample's size
    orders, nations, customers = read("orders", "o_orderkey"), read("nation", "n_nationkey"), read("customer", "c_custkey")
    ole = lambda r: (r.o_orderdate.toordinal() - dates.OLE_EPOCH.toordinal()) + 0.25
    text = lambda name: (name, filegdb.STRING, True)
    shape = ("SHAPE", filegdb.GEOMETRY, True)
    places = [(float(c.c_custkey % 1000), float(c.c_acctbal // 10)) for c in customers]
    items = [("Priorities", None, _domain("Priorities", sorted({o.o_orderpriority for o in orders}))), ("orders_t", "/sales/orders_t", "<Subtypes><Subtype xsi:type='x'><SubtypeName>Open</SubtypeName><SubtypeCode>1</SubtypeCode></Subtype><Subtype xsi:type='x'><SubtypeName>Shut</SubtypeName><SubtypeCode>2</SubtypeCode></Subtype></Subtypes>"), ("nations", "/places/nations", None), ("squares", "/places/squares", None)]
    directory = f"{shared_dir(spark).removeprefix('file://')}/sample-{len(_SAMPLES)}-{key[0]}.gdb"
    write_geodatabase(
        directory,
        {
            "GDB_Items": (TableWriter([_ID, text("Name"), text("Path"), ("Definition", filegdb.XML, True)]), items),
            "orders_t": (
                TableWriter([_ID, ("okey", filegdb.INT64, False), ("cust", filegdb.INT32, True), text("status"), ("price", filegdb.FLOAT64, True), ("made", filegdb.DATETIME, True), ("local_made", filegdb.DATETIME_OFFSET, True), ("code", filegdb.UUID_1, True)]),
                [None if o.o_orderkey % 10 == 3 else (o.o_orderkey, None if o.o_orderkey % 7 == 0 else o.o_custkey, None if o.o_orderstatus == "F" else o.o_orderstatus, o.o_totalprice, ole(o), (ole(o), -90), bytes(range(16))) for o in orders],
            ),
            "nations": (TableWriter([_ID, ("nkey", filegdb.INT16, False), text("name"), shape], "point"), [(n.n_nationkey, n.n_name, None if n.n_nationkey % 5 == 4 else blob("point", [[(n.n_nationkey * 2.0, n.n_regionkey * 1.5)]])) for n in nations]),
            "squares": (TableWriter([_ID, ("ckey", filegdb.INT64, False), text("segment"), shape], "polygon"), [(c.c_custkey, c.c_mktsegment, blob("polygon", [_ring(x, y, 8, False), _ring(x, y, 4, True)])) for c, (x, y) in zip(customers, places, strict=True)]),
            "paths": (TableWriter([_ID, ("ckey", filegdb.INT64, False), shape], "line"), [(c.c_custkey, blob("line", [[(x, y), (x + 30, y), (x + 30, y + 40)]])) for c, (x, y) in zip(customers, places, strict=True)]),
            "clusters": (TableWriter([_ID, ("ckey", filegdb.INT64, False), shape], "multipoint"), [(c.c_custkey, blob("multipoint", [[(x, y), (x + 30, y + 40)]])) for c, (x, y) in zip(customers, places, strict=True)]),
        },
    )
    _SAMPLES[key] = Dataset.open(spark, directory, system=True)
    return _SAMPLES[key]


Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}

_ORDERS = """(SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS fid, o_orderkey AS okey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust, nullif(o_orderstatus, 'F') AS status, o_totalprice AS price,
    (o_orderdate::DATE - DATE '1899-12-30') + 0.25::DOUBLE AS made FROM orders) WHERE fid < 3000 AND okey % 10 <> 3)"""
_NATIONS = "(SELECT n_nationkey AS fid, n_nationkey::INTEGER AS nkey, n_name AS name, CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey * 2.0 END AS x, n_regionkey * 1.5 AS y FROM nation)"
_PLACES = "(SELECT * FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS fid, c_custkey AS ckey, c_mktsegment AS segment, (c_custkey % 1000)::DOUBLE AS x, floor(c_acctbal / 10)::DOUBLE AS y FROM customer) WHERE fid < 3000)"
_BOX = (100.5, 300.25, 220.5, 500.75)
_HIT = "x - 8 <= {2} AND x + 8 >= {0} AND y - 8 <= {3} AND y + 8 >= {1} AND NOT (x - 4 < {0} AND x + 4 > {2} AND y - 4 < {1} AND y + 4 > {3})".format(*_BOX)
_LEGS = "(x <= {2} AND x + 30 >= {0} AND y BETWEEN {1} AND {3}) OR (x + 30 BETWEEN {0} AND {2} AND y <= {3} AND y + 40 >= {1})".format(*_BOX)
_DOTS = "(x BETWEEN {0} AND {2} AND y BETWEEN {1} AND {3}) OR (x + 30 BETWEEN {0} AND {2} AND y + 40 BETWEEN {1} AND {3})".format(*_BOX)


def _add(name: str, layer: str, run: Callable[[Layer], DataFrame], sql: str) -> None:
    QUERIES[f"gdb_{name}"] = lambda spark, sf_dir: run(sample(spark, sf_dir).layer(layer))
    ORACLE_SQL[f"gdb_{name}"] = sql


def _rows(name: str, layer: str, query: Query, sql: str) -> None:
    _add(name, layer, lambda found: found.query(query), sql)


_add("scan", "orders_t", lambda layer: layer.query(Query()).select("fid", "objectid", "okey", "cust", "status", "price", "made", F.col("local_made.ole").alias("local"), F.col("local_made.offset_minutes").alias("minutes"), "code"), f"SELECT fid, fid + 1 AS objectid, okey, cust, status, price, made, made AS local, -90 AS minutes, '03020100-0504-0706-0809-0a0b0c0d0e0f' AS code FROM {_ORDERS}")
_rows("project", "orders_t", Query(fields=("okey", "price")), f"SELECT fid, okey, price FROM {_ORDERS}")
_rows("where", "orders_t", Query(fields=("okey",), where="PRICE > 100000 AND status != 'O' OR cust <= 20"), f"SELECT fid, okey FROM {_ORDERS} WHERE (price > 100000 AND (status IS NULL OR status <> 'O')) OR cust <= 20")
_rows("where_fraction", "orders_t", Query(fields=("okey",), where="cust != 12.5 AND okey > 999.5"), f"SELECT fid, okey FROM {_ORDERS} WHERE okey > 999.5")
_rows("where_uuid", "orders_t", Query(fields=("okey",), where="code = '03020100-0504-0706-0809-0a0b0c0d0e0f' AND code >= 'zz' OR code < '1'"), f"SELECT fid, okey FROM {_ORDERS}")
_rows("where_date", "orders_t", Query(fields=("okey",), where="made >= 35065.25 AND made < 35430"), f"SELECT fid, okey FROM {_ORDERS} WHERE made >= 35065.25 AND made < 35430")
_rows("where_date_with_offset", "orders_t", Query(fields=("okey",), where="local_made >= 35065.25 AND local_made != 35100.25"), f"SELECT fid, okey FROM {_ORDERS} WHERE made >= 35065.25 AND made <> 35100.25")
_rows("read_by_fid", "orders_t", Query(fid=7, fields=("okey",)), f"SELECT fid, okey FROM {_ORDERS} WHERE fid = 7")
_rows("seek_order_page", "orders_t", Query(from_fid=40, by_fid=True, offset=3, limit=9, fields=("okey",)), f"SELECT fid, okey FROM {_ORDERS} WHERE fid >= 40 ORDER BY fid LIMIT 9 OFFSET 3")
_add("count", "orders_t", lambda layer: layer.query(Query(where="cust > 30")).agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM {_ORDERS} WHERE cust > 30")
_rows("case_of_names", "ORDERS_T", Query(fields=("okey",), where="STATUS = 'O'"), f"SELECT fid, okey FROM {_ORDERS} WHERE status = 'O'")
_rows("bbox_point_null", "nations", Query(fields=("nkey", "name"), box=(4.0, 0.0, 30.0, 4.5), with_geometry=False), f"SELECT fid, nkey, name FROM {_NATIONS} WHERE x BETWEEN 4 AND 30 AND y <= 4.5")
_add("point_geometry", "nations", lambda layer: layer.query(Query()).select("nkey", F.col("geom.status").alias("status"), F.col("gbox.xmin").alias("x"), F.col("gbox.ymax").alias("y")), f"SELECT nkey, CASE WHEN x IS NULL THEN 'null' ELSE 'valid' END AS status, x::DOUBLE AS x, CASE WHEN x IS NOT NULL THEN y END::DOUBLE AS y FROM {_NATIONS}")
_rows("bbox_polygon", "squares", Query(fields=("ckey",), box=_BOX, with_geometry=False), f"SELECT fid, ckey FROM {_PLACES} WHERE {_HIT}")
_rows("bbox_polygon_where", "squares", Query(fields=("ckey", "segment"), box=_BOX, where="segment IN ('BUILDING', 'MACHINERY')", with_geometry=False), f"SELECT fid, ckey, segment FROM {_PLACES} WHERE segment IN ('BUILDING', 'MACHINERY') AND {_HIT}")
_rows("bbox_line", "paths", Query(fields=("ckey",), box=_BOX, with_geometry=False), f"SELECT fid, ckey FROM {_PLACES} WHERE {_LEGS}")
_rows("bbox_multipoint", "clusters", Query(fields=("ckey",), box=_BOX, with_geometry=False), f"SELECT fid, ckey FROM {_PLACES} WHERE {_DOTS}")
_add("extent", "squares", lambda layer: relations.extent(layer.df), f"SELECT min(x) - 8 AS xmin, min(y) - 8 AS ymin, max(x) + 8 AS xmax, max(y) + 8 AS ymax FROM {_PLACES}")
_add(
    "polygon_wkt",
    "squares",
    lambda layer: geometry.with_wkt(layer.query(Query()).select("ckey", F.col("geom.wkb").alias("wkb"))).select("ckey", "wkt"),
    f"""WITH q AS (SELECT ckey, x::BIGINT AS x, y::BIGINT AS y FROM {_PLACES})
    SELECT ckey, 'MULTIPOLYGON (((' || (x+8) || ' ' || (y-8) || ', ' || (x+8) || ' ' || (y+8) || ', ' || (x-8) || ' ' || (y+8) || ', ' || (x-8) || ' ' || (y-8) || ', ' || (x+8) || ' ' || (y-8)
        || '), (' || (x-4) || ' ' || (y+4) || ', ' || (x+4) || ' ' || (y+4) || ', ' || (x+4) || ' ' || (y-4) || ', ' || (x-4) || ' ' || (y-4) || ', ' || (x-4) || ' ' || (y+4) || ')))' AS wkt FROM q""",
)
_add("line_wkt", "paths", lambda layer: geometry.with_wkt(layer.query(Query()).select("ckey", F.col("geom.wkb").alias("wkb"))).select("ckey", "wkt"), f"WITH q AS (SELECT ckey, x::BIGINT AS x, y::BIGINT AS y FROM {_PLACES}) SELECT ckey, 'MULTILINESTRING ((' || x || ' ' || y || ', ' || (x+30) || ' ' || y || ', ' || (x+30) || ' ' || (y+40) || '))' AS wkt FROM q")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = sample(spark, sf_dir)
    return spark.createDataFrame([(name, dataset.layer(name).name) for name in dataset.layer_names()], "name string, path string")


QUERIES["gdb_layers"] = _tree
ORACLE_SQL["gdb_layers"] = "SELECT * FROM (VALUES ('GDB_Items', '/GDB_Items'), ('GDB_SystemCatalog', '/GDB_SystemCatalog'), ('clusters', '/clusters'), ('nations', '/nations'), ('orders_t', '/orders_t'), ('paths', '/paths'), ('squares', '/squares')) t(name, path)"
QUERIES["gdb_files"] = lambda spark, sf_dir: relations.inventory(sample(spark, sf_dir).files()).select("ext", "n_files")
ORACLE_SQL["gdb_files"] = "SELECT unnest(['gdbtable', 'gdbtablx']) AS ext, 7 AS n_files"
QUERIES["gdb_domains"] = lambda spark, sf_dir: metadata.domains(sample(spark, sf_dir).layer("GDB_Items").df.withColumnRenamed("Definition", "definition")).select("name", "type", "field_type", F.explode("coded_values").alias("c")).select("name", "type", "field_type", "c.code", F.col("c.name").alias("label"))
ORACLE_SQL["gdb_domains"] = "SELECT DISTINCT 'Priorities' AS name, 'typens:GPCodedValueDomain2' AS type, 'esriFieldTypeString' AS field_type, p AS code, lower(p) AS label FROM (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3000"
QUERIES["gdb_subtypes"] = lambda spark, sf_dir: metadata.subtypes(sample(spark, sf_dir).layer("GDB_Items").df.withColumnRenamed("Definition", "definition")).select("code", "name")
ORACLE_SQL["gdb_subtypes"] = "SELECT * FROM (VALUES (1, 'Open'), (2, 'Shut')) t(code, name)"
QUERIES["gdb_groups"] = lambda spark, sf_dir: relations.group_members(sample(spark, sf_dir).layer("GDB_Items").df.where("Path is not null").select(F.col("Path").alias("path")))
ORACLE_SQL["gdb_groups"] = "SELECT * FROM (VALUES ('/sales', 'orders_t', 1), ('/places', 'nations,squares', 2)) t(parent, members, n_members)"
QUERIES["gdb_audit"] = lambda spark, sf_dir: sample(spark, sf_dir).audit().select("name", "status", "n_rows")
ORACLE_SQL["gdb_audit"] = "SELECT * FROM (VALUES ('GDB_Items', 'ok', 4), ('GDB_ItemRelationships', 'missing', 0), ('GDB_ItemRelationshipTypes', 'missing', 0), ('GDB_ItemTypes', 'missing', 0), ('GDB_SpatialRefs', 'missing', 0)) t(name, status, n_rows)"
QUERIES["gdb_metrics"] = lambda spark, sf_dir: (lambda layer: spark.createDataFrame([layer.metrics(Query(box=_BOX))]))(sample(spark, sf_dir).layer("squares"))
ORACLE_SQL["gdb_metrics"] = f"""SELECT count(*) FILTER (WHERE m) AS candidates, count(*) FILTER (WHERE NOT m) AS rejected, count(*) FILTER (WHERE i) AS contained, count(*) FILTER (WHERE m AND NOT i) AS tested, count(*) FILTER (WHERE h) AS matched, 0 AS invalid
    FROM (SELECT x - 8 <= {_BOX[2]} AND x + 8 >= {_BOX[0]} AND y - 8 <= {_BOX[3]} AND y + 8 >= {_BOX[1]} AS m, x - 8 >= {_BOX[0]} AND x + 8 <= {_BOX[2]} AND y - 8 >= {_BOX[1]} AND y + 8 <= {_BOX[3]} AS i, {_HIT} AS h FROM {_PLACES}) z"""

_SMALL = (5.0, 180.0, 6.0, 190.0)
for _relation, _condition in (
    ("intersects", _HIT),
    # the box lies between the outer ring and the hole, strictly
    ("contains", "x - 8 < {0} AND x + 8 > {2} AND y - 8 < {1} AND y + 8 > {3} AND (x - 4 > {2} OR x + 4 < {0} OR y - 4 > {3} OR y + 4 < {1})".format(*_SMALL)),
):
    _add(
        _relation,
        "squares",
        lambda layer, r=_relation: layer.df.where(spatial.relation(spatial.POLYGON, r, spatial.Box(*(_SMALL if r == "contains" else _BOX)), F.col("gbox"), F.col("gparts"))).select("ckey"),
        f"SELECT ckey FROM {_PLACES} WHERE {_condition}",
    )
