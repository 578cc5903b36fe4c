"""Geodatabase directories, datasets, cursors, metadata and relations."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from cairnfield import cli
from cairnfield.catalog import Budget, Dataset, parse_uri, route
from cairnfield.errors import Code, EngineError
from cairnfield.functions import dates, text
from cairnfield.operators import relations
from cairnfield.plans.query import Query
from cairnfield.sources import filegdb, metadata
from cairnfield.streaming.filters import filtered_stream


def test_tables(gdb_dir):
    db = filegdb.Geodatabase(gdb_dir)
    assert db.layer_names() == ["notes", "places"] and db.layer_names(system=True)[:2] == ["GDB_Items", "GDB_SystemCatalog"]
    assert db.resolve("PLACES") == 2 and db.open("places").geometry.grid.xy_scale == 1000.0
    first, second = (row for _, row in db.open("notes").rows())
    assert first == {"OBJECTID": 1, "s": -7, "b": 1 << 40, "f": 0.5, "d": 2.25, "u": "03020100-0504-0706-0809-0a0b0c0d0e0f", "raw": b"\x00\x01", "t": 36526.5, "o": (36526.25, -90), "x": "<a/>"}
    assert second["s"] is None and second["x"] is None
    assert [fid for fid, _ in db.open("places").rows()] == [0, 1, 2, 3, 4, 6]
    with pytest.raises(EngineError):
        db.resolve("nothing")


def test_sparse_offset_file(gdb_dir):
    table = filegdb.Geodatabase(gdb_dir).open("places")
    path = table.path[:-5] + "tablx"
    data = open(path, "rb").read()
    import struct

    head, block = data[:16], data[16 : 16 + 1024 * 5]
    with open(path, "wb") as out:  # the first block is left out
        out.write(struct.pack("<IIII", 3, 1, 1024 + 7, 5) + block + struct.pack("<IIII", 1, 2, 2, 0) + bytes([0b10, 0, 0, 0]))
    assert head and [fid for fid, _ in table.rows()] == [1024 + k for k in (0, 1, 2, 3, 4, 6)] and len(table) == 1031
    assert table.offsets(1020, 1026)[:4] == [0] * 4 and table.offsets(1020, 1026)[4] > 0


def test_source(spark, gdb_dir):
    df = filegdb.read_layer(spark, gdb_dir, "places", rows_per_task="3")
    assert df.rdd.getNumPartitions() > 1
    rows = {r.fid: r for r in df.collect()}
    assert rows[3].objectid == 4 and rows[4].name == "成都" and rows[6].geom.status == "null" and rows[6].gbox is None
    assert rows[1].geom.wkb is not None and rows[1].gbox.xmin == 2.0 and rows[1].gkind == "point"
    assert filegdb.read_layer(spark, gdb_dir, "places", fields="name").columns[:3] == ["fid", "objectid", "name"]
    assert filegdb.read_layer(spark, gdb_dir, "notes").count() == 2


def test_dataset_queries(spark, gdb_dir):
    places = Dataset.open(spark, gdb_dir).layer("places")
    fids = lambda **q: [r.fid for r in places.query(Query(by_fid=True, **q)).collect()]
    assert fids(box=(0, 0, 5, 5), where="value >= 10") == [1, 3]
    assert fids(where="value != 10") == [0, 3, 4, 6]
    assert fids(where="name = '成都'") == [4]
    assert fids(box=(1, 1, 1, 1)) == [0]
    assert places.read(3).value == 15 and places.read(5) is None
    assert places.extent() == type(places.extent())(1.0, 1.0, 20.0, 20.0)
    assert places.count() == 6 and places.capabilities()["box"] and not places.capabilities()["write"]
    assert places.metrics(Query(box=(0, 0, 5, 5))).invalid == 1
    assert "spatial_where" in places.explain(Query(box=(0, 0, 5, 5), where="value = 1"))
    notes = Dataset.open(spark, gdb_dir).layer("NOTES")
    with pytest.raises(EngineError) as error:
        notes.query(Query(box=(0, 0, 1, 1)))
    assert error.value.code == Code.UNSUPPORTED


def test_cursor_and_budgets(spark, gdb_dir):
    places = Dataset.open(spark, gdb_dir).layer("places")
    cursor = places.cursor()
    assert next(cursor).fid == 0
    cursor.move_to(5)
    assert next(cursor).fid == 6
    cursor.move_to(1)
    assert next(cursor).fid == 1
    cursor.cancel()
    with pytest.raises(EngineError) as error:
        next(cursor)
    assert error.value.code == Code.CANCELLED
    assert len(places.read_all()) == 6
    for budget in (Budget(features=5), Budget(total_bytes=20), Budget(feature_bytes=3)):
        with pytest.raises(EngineError):
            places.read_all(budget=budget)
    with pytest.raises(EngineError) as error:
        places.query(Query(max_features=5))
    assert error.value.code == Code.RESULT_LIMIT
    late = places.cursor(timeout=0.0)
    import time

    time.sleep(0.1)
    with pytest.raises(EngineError) as error:
        next(late)
    assert error.value.code == Code.DEADLINE


def test_changed_source(spark, gdb_dir):
    dataset = Dataset.open(spark, gdb_dir)
    os.utime(os.path.join(gdb_dir, "a00000002.gdbtable"), ns=(1, 1))
    with pytest.raises(EngineError) as error:
        dataset.layer("places").query(Query())
    assert error.value.code == Code.SOURCE_CHANGED


def test_damaged_files(gdb_dir):
    path = os.path.join(gdb_dir, "a00000003.gdbtable")
    data = open(path, "rb").read()
    for n in (0, 3, 39, 60, len(data) - 5):
        with open(path, "wb") as out:
            out.write(data[:n])
        with pytest.raises(EngineError):
            list(filegdb.TableFile(path).rows())


def test_groups_and_addresses(spark):
    df = spark.range(3).selectExpr("id as fid", "id as v")
    dataset = Dataset(spark, {"/roads/lines": (df, None), "roads\\points": (df, None), "parcels": (df, None), "/x/lines": (df, None)})
    assert dataset.group().layers == ["parcels"] and dataset.group().groups == ["roads", "x"]
    assert dataset.group("/roads/").layers == ["lines", "points"]
    assert dataset.layer("/roads/lines").count() == 3 and dataset.layer("POINTS").count() == 3
    with pytest.raises(EngineError) as error:
        dataset.layer("lines")
    assert error.value.code == Code.AMBIGUOUS
    with pytest.raises(EngineError):
        dataset.group("/nothing")
    dataset.register_views()
    assert spark.sql("select count(*) from points where v >= 1").first()[0] == 2
    assert parse_uri("s3://bucket/a/b.gdb/") == "s3a://bucket/a/b.gdb" and parse_uri("file:///a/b.gdb") == "/a/b.gdb"
    for bad in ("", "s3:///x", "s3://UPPER/x", "s3://bucket/", "a\x00b", "x" * 9000):
        with pytest.raises(EngineError):
            parse_uri(bad)


def test_cli(gdb_dir, capsys):
    for args in (["explore", gdb_dir], ["dump-table", gdb_dir, "places"], ["dump-tablx", gdb_dir, "places"], ["dump-records", gdb_dir, "notes", "--limit", "1"]):
        assert cli.main(args) == 0
        assert all(json.loads(line) for line in capsys.readouterr().out.splitlines())


def test_relationships(spark):
    rel = spark.createDataFrame([("r1", "T1", "A", "b"), ("r2", "t9", "a", None)], "uuid string, type string, origin_id string, dest_id string")
    types = spark.createDataFrame([("t1", "first", 1), ("T1", "second", 2)], "uuid string, name string, fid int")
    items = spark.createDataFrame([("a", "roads", "/roads", 1), ("B", "parks", "/g/parks", 2), ("A", "other", "/other", 3)], "uuid string, name string, path string, fid int")
    got = {r.uuid: tuple(r)[1:] for r in relations.relationship_summary(rel, types, items).collect()}
    assert got == {"r1": ("first", "roads", "/roads", "parks", "/g/parks"), "r2": ("", "roads", "/roads", "", "")}
    assert [tuple(r) for r in relations.group_members(items).orderBy("parent").collect()] == [("/", "other,roads", 2), ("/g", "parks", 1)]
    index = relations.index_fields(spark.createDataFrame([("i1", "NAME"), ("i2", "LOWER(NAME)")], "index string, expression string"), spark.createDataFrame([("name",)], "field string"))
    assert [tuple(r) for r in index.collect()] == [("i1", "name")]


def test_digest_and_audit(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    same = relations.table_digest(df.select("y", "x").orderBy(F.desc("x"))).first()
    assert relations.table_digest(df).first() == same and same.n_rows == 2
    got = {r.name: r.status for r in relations.audit({"a": df, "b": df.limit(0), "c": None}).collect()}
    assert got == {"a": "ok", "b": "empty", "c": "missing"}


XML = """<Domain xsi:type="typens:GPCodedValueDomain2"><DomainName> Status </DomainName><FieldType>esriFieldTypeString</FieldType><CodedValues><CodedValue><Name>Open</Name><Code>O</Code></CodedValue><CodedValue><Name>Shut</Name><Code>S</Code></CodedValue></CodedValues></Domain>"""
RANGE = """<Domain xsi:type='typens:GPRangeDomain2'><DomainName>Speed</DomainName><MinValue>0</MinValue><MaxValue>120</MaxValue></Domain>"""
LAYER = """<DETableInfo><Subtype><SubtypeName>Main</SubtypeName><SubtypeCode>2</SubtypeCode></Subtype><GPFieldInfoEx><Name>status</Name><DomainName>Status</DomainName></GPFieldInfoEx><GPFieldInfoEx><Name>other</Name></GPFieldInfoEx></DETableInfo>"""
CLASS = """<R><Cardinality>esriRelCardinalityOneToMany</Cardinality><ForwardPathLabel>has</ForwardPathLabel><IsComposite>false</IsComposite><RelationshipClassKey><ObjectKeyName>road_id</ObjectKeyName><KeyRole>esriRelKeyRoleOriginPrimary</KeyRole></RelationshipClassKey></R>"""


def test_metadata(spark):
    items = spark.createDataFrame([(1, "w", "W", "/", XML + RANGE), (2, "roads", "ROADS", "/g/roads", LAYER), (3, "rel", "REL", "/rel", CLASS), (4, "n", "N", "/n", None)], "fid int, name string, physical_name string, path string, definition string")
    got = {r.name: r for r in metadata.domains(items).collect()}
    assert got["Status"].type == "typens:GPCodedValueDomain2" and [tuple(c) for c in got["Status"].coded_values] == [("O", "Open"), ("S", "Shut")]
    assert (got["Speed"].min_value, got["Speed"].max_value) == ("0", "120")
    assert [tuple(r) for r in metadata.subtypes(items).collect()] == [(2, "Main", "")]
    assert [tuple(r) for r in metadata.field_bindings(items).collect()] == [("roads", "status", "Status")]
    rel = metadata.relationship_attributes(items).first()
    assert (rel.cardinality, rel.forward_label, rel.origin_primary_key, rel.origin_foreign_key, rel.is_composite) == ("OneToMany", "has", "road_id", "", False)
    assert metadata.layer_item(items, "ROADS").first().fid == 2
    bound = relations.field_domains(metadata.field_bindings(items), metadata.domains(items)).first()
    assert bound.domain_type == "typens:GPCodedValueDomain2"
    assert {r.parent: r.members for r in metadata.groups(items.where("path <> '/'")).collect()} == {"/": ["n", "rel"], "/g": ["roads"]}


def test_metadata_of_a_directory(spark, gdb_dir):
    dataset = Dataset.open(spark, gdb_dir)
    found = dataset.metadata()
    assert [(r.name, r.type, r.min_value) for r in found["domains"].collect()] == [("Level", "typens:GPRangeDomain2", "1")]
    assert [tuple(r) for r in found["groups"].collect()] == [("/g", ["places"])]
    assert {r.name: r.status for r in dataset.audit().collect()} == {"GDB_Items": "ok", "GDB_ItemRelationships": "missing", "GDB_ItemRelationshipTypes": "missing", "GDB_ItemTypes": "missing", "GDB_SpatialRefs": "missing"}
    assert {r.ext: r.n_files for r in relations.inventory(dataset.files()).collect()} == {"gdbtable": 4, "gdbtablx": 4}
    assert "GDB_Items" not in dataset.layer_names() and dataset.system_table("nothing") is None
    assert route("s3://bucket/a.gdb").source == "object store" and route(gdb_dir).engine == "spark"


def test_raw_rows_and_undecodable_geometry(spark, gdb_dir):
    rows = filegdb.read_layer(spark, gdb_dir, "notes", raw="true").orderBy("fid").collect()
    table = filegdb.Geodatabase(gdb_dir).open("notes")
    assert table.decode(0, bytes(rows[0].raw_row))["s"] == -7
    from cairnfield.operators.geometry import Grid, peek_envelope, unsigned_bytes

    patch = b"".join(map(unsigned_bytes, (54, 4, 10, 1, 1000, 2000, 500, 250))) + b"..."
    assert peek_envelope(patch, Grid(xy_scale=1000.0)) == (1.0, 2.0, 1.5, 2.25)
    geom, box, parts, _ = filegdb.geometry_row(patch, Grid(xy_scale=1000.0), False, "keep_status")
    assert geom[0] is None and geom[4] == "unsupported type" and box == (1.0, 2.0, 1.5, 2.25) and parts is None
    with pytest.raises(EngineError):
        filegdb.geometry_row(patch, Grid(), False, "fail")


def test_functions(spark):
    row = spark.range(1).select(
        dates.ole_text(F.lit(-0.5)).alias("negative"),
        dates.ole_text(F.lit(36526.7500001)).alias("rounded"),
        dates.ole_text(F.lit(2.25), "time").alias("time"),
        dates.offset_minutes(F.lit(94)).alias("offset"),
        text.uuid_text(F.lit(bytes(range(16)))).alias("uuid"),
        text.quoted(F.lit("it's")).alias("quoted"),
        text.canonical_path(F.lit("a\\b//c/")).alias("path"),
        text.parent_path(F.lit("/a")).alias("parent"),
        text.utf16_text(F.lit("a😀\x00z".encode("utf-16-le"))).alias("utf16"),
        text.cell_id(F.lit(-0.5), 1.0).alias("cell"),
    ).first()
    assert tuple(row) == ("1899-12-29 12:00:00", "2000-01-01 18:00:00", "06:00:00", -90, "03020100-0504-0706-0809-0a0b0c0d0e0f", "'it''s'", "/a/b/c", "/", "a😀", (1 << 29) - 1)


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).selectExpr("id as fid", "id as v").write.parquet(source)
    stream = spark.readStream.schema("fid long, v long").parquet(source)
    query = filtered_stream(stream, Query(where="v >= 7")).writeStream.format("memory").queryName("kept").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.v for r in spark.table("kept").collect()) == [7, 8, 9]
    with pytest.raises(EngineError):
        filtered_stream(stream, Query(limit=1))


def test_box_columns_and_ids_reach_the_directory(spark):
    from cairnfield import directory_queries
    from tests.conftest import SF_SMALL

    dataset = directory_queries.sample(spark, SF_SMALL)
    squares = dataset.layer("squares")
    narrow = squares._scan(Query(fields=("ckey",), box=(100.0, 300.0, 220.0, 500.0)))
    assert narrow.columns == ["fid", "objectid", "ckey", "geom", "gbox", "gparts", "gkind"]
    whole = squares.df.where("gbox.xmin <= 220 and gbox.xmax >= 100 and gbox.ymin <= 500 and gbox.ymax >= 300")
    assert narrow.count() == whole.count() < squares.df.count()
    orders = dataset.layer("orders_t")
    assert orders._scan(Query(fields=("okey",), where="PRICE > 5", fid=4)).columns == ["fid", "objectid", "okey", "price"]
    assert orders._scan(Query(fid=4)).count() == 1 and orders._scan(Query(from_fid=100)).agg({"fid": "min"}).first()[0] >= 100
    assert orders.read(4).okey == orders.query(Query(where="okey >= 0")).where("fid = 4").first().okey


def test_triangle_of_a_directory_is_tested_exactly(spark, tmp_path):
    from cairnfield.sources import filegdb
    from cairnfield.sources.writer import TableWriter, blob, write_geodatabase

    fields = [("OBJECTID", filegdb.OBJECTID, False), ("SHAPE", filegdb.GEOMETRY, True)]
    path = str(tmp_path / "t.gdb")
    write_geodatabase(path, {"t": (TableWriter(fields, "polygon"), [(blob("polygon", [[(0, 0), (0, 10), (10, 0), (0, 0)]]),), (None,)])})
    layer = Dataset.open(spark, path).layer("t")
    assert layer.count(Query(box=(8, 8, 9, 9))) == 0 and layer.count(Query(box=(1, 1, 2, 2))) == 1 and layer.count() == 2


@pytest.mark.parametrize("uri", ["s3://bucket/a?b.gdb", "s3://bucket/a//b.gdb", "s3://bucket/../b.gdb", "s3://bucket/u@b.gdb", "s3://bucket/plain", "s3://bucket/b.gdb"])
def test_object_store_addresses_are_refused(spark, uri):
    with pytest.raises(EngineError):
        Dataset.open(spark, uri)
