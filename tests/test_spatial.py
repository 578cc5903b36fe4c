"""Boxes against shapes, held against an independent clipping test on dyadic coordinates."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnfield.errors import EngineError
from cairnfield.operators import spatial
from cairnfield.plans.query import Query, build, metrics
from cairnfield.sources.layers import extent_of, spatially_stored, with_fids


def clip(a, b, box):
    """Liang-Barsky: does the segment meet the closed box?"""
    low, high = 0.0, 1.0
    for start, delta, near, far in ((a[0], b[0] - a[0], box.xmin, box.xmax), (a[1], b[1] - a[1], box.ymin, box.ymax)):
        if delta == 0:
            if not near <= start <= far:
                return False
            continue
        t, u = (near - start) / delta, (far - start) / delta
        low, high = max(low, min(t, u)), min(high, max(t, u))
    return low <= high


def in_polygon(p, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def expected(kind, parts, box):
    closed = kind == spatial.POLYGON
    if kind == spatial.MULTIPOINT:
        return any(box.xmin <= x <= box.xmax and box.ymin <= y <= box.ymax for part in parts for x, y in part)
    for part in parts:
        edges = list(zip(part, part[1:] + part[:1] if closed else part[1:], strict=False)) or [(part[0], part[0])]
        if any(clip(a, b, box) for a, b in edges):
            return True
    return closed and in_polygon((box.xmin, box.ymin), parts)


SCHEMA = "n int, gparts array<array<struct<x:double,y:double>>>"


def frame(spark, shapes):
    df = spark.createDataFrame([(n, [[{"x": float(x), "y": float(y)} for x, y in part] for part in parts]) for n, parts in enumerate(shapes)], SCHEMA)
    return df.withColumn("gbox", spatial.envelope(F.col("gparts")))


@pytest.mark.parametrize("kind", [spatial.MULTIPOINT, spatial.LINE, spatial.POLYGON])
def test_random_shapes(spark, kind):
    rng = random.Random(5)
    pick = lambda: (rng.randrange(0, 64) / 4, rng.randrange(0, 64) / 4)
    shapes = [[[pick() for _ in range(rng.randint(3 if kind == spatial.POLYGON else 1, 6))] for _ in range(rng.randint(1, 2))] for _ in range(250)]
    df = frame(spark, shapes).cache()
    boxes = []
    for _ in range(8):
        (x0, x1), (y0, y1) = (sorted(rng.randrange(0, 64) / 4 for _ in range(2)) for _ in range(2))
        boxes.append(spatial.Box(x0, y0, x1, y1))
    found = df.select("n", *(spatial.meets(kind, b, F.col("gbox"), F.col("gparts")).alias(f"b{k}") for k, b in enumerate(boxes))).collect()
    for r in found:
        for k, b in enumerate(boxes):
            assert r[f"b{k}"] == expected(kind, shapes[r["n"]], b), (kind, shapes[r["n"]], b)


def test_holes(spark):
    square = [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)]]
    df = frame(spark, [square])
    hit = lambda *sides: df.where(spatial.meets(spatial.POLYGON, spatial.Box(*sides), F.col("gbox"), F.col("gparts"))).count() == 1
    assert not hit(3, 3, 5, 5)  # in the hole
    assert hit(2, 3, 5, 5)  # touches the hole's edge
    assert hit(0.5, 0.5, 1, 1)  # inside, no edge near
    assert hit(-5, -5, 0, 0) and not hit(-5, -5, -1, -1)
    assert hit(-5, -5, 20, 20)


def test_relations_and_area(spark):
    df = frame(spark, [[[(0, 0), (8, 0), (8, 8), (0, 8)]], [[(20, 20), (20, 22), (22, 22), (22, 20)]]])
    rel = lambda name, *sides: [r.n for r in df.where(spatial.relation(spatial.POLYGON, name, spatial.Box(*sides), F.col("gbox"), F.col("gparts"))).orderBy("n").collect()]
    assert rel("contains", 1, 1, 2, 2) == [0] and rel("within", -1, -1, 9, 9) == [0] and rel("disjoint", 0, 0, 9, 9) == [1] and rel("intersects", 5, 5, 21, 21) == [0, 1]
    assert [r.a for r in df.orderBy("n").select(spatial.signed_area(F.col("gparts")[0]).alias("a")).collect()] == [64.0, -4.0]
    null = df.limit(1).select(F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>").alias("gbox"), "gparts")
    assert null.where(spatial.relation(spatial.POLYGON, "disjoint", spatial.Box(0, 0, 1, 1), F.col("gbox"), F.col("gparts"))).count() == 1


def test_boxes():
    for bad in ((1, 0, 0, 1), (0, 1, 1, 0), (math.nan, 0, 1, 1)):
        with pytest.raises(EngineError):
            spatial.Box(*bad)
    whole = spatial.Box(0, 0, 10, 10)
    assert spatial.coverage(spatial.Box(0, 0, 5, 5), whole) == 0.25
    assert spatial.coverage(spatial.Box(20, 20, 30, 30), whole) == 0.0
    assert spatial.coverage(spatial.Box(-9, -9, 99, 99), whole) == 1.0
    assert spatial.coverage(whole, spatial.Box(3, 3, 3, 3)) == 1.0


def test_box_reaches_the_scan_and_storage_skips(spark):
    points = spark.range(4000).selectExpr("id as fid", "struct(cast(id % 64 as double) as xmin, cast(id div 64 as double) as ymin, cast(id % 64 as double) as xmax, cast(id div 64 as double) as ymax) as gbox")
    held = spatially_stored(points, "test-points")
    assert extent_of(held) == spatial.Box(0, 0, 63, 62)
    query = Query(box=(3, 3, 9, 9))
    plan = build(held, query)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(gbox.xmin,9.0)" in plan and "GreaterThanOrEqual(gbox.ymax,3.0)" in plan
    assert build(held, query).count() == 49
    row = metrics(held, query).first()
    assert (row.candidates, row.contained, row.tested, row.matched) == (49, 49, 0, 49)


def test_fids_follow_the_keys(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("pmod(hash(id), 100000) as k", "id")
    got = [(r.fid, r.k, r.id) for r in with_fids(df, "k", "id").orderBy("fid").collect()]
    assert [g[0] for g in got] == list(range(3000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert with_fids(df.limit(0), "k").count() == 0
