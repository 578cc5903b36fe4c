"""Codecs: round trips of hand-made blobs, topology, curves, WKB and WKT, and damage of every kind."""

from __future__ import annotations

import math
import random
import struct

import pytest

from cairnfield.operators import geometry as G
from cairnfield.operators.spatial import LINE, MULTIPOINT, POINT, POLYGON

GRID = G.Grid(-400.0, -400.0, 1000.0, 0.0, 100.0, 0.0, 10.0)


def grid(x: float) -> int:
    return round((x + 400) * 1000)


def deltas(values) -> bytes:
    out, last = b"", 0
    for v in values:
        out += G.signed_bytes(v - last)
        last = v
    return out


def places(points) -> bytes:
    out, x, y = b"", 0, 0
    for px, py in points:
        out += G.signed_bytes(grid(px) - x) + G.signed_bytes(grid(py) - y)
        x, y = grid(px), grid(py)
    return out


def shape(code: int, parts, zs=None, ms=b"", curves: bytes = b"", n_curves: int = 0) -> bytes:
    points = [p for part in parts for p in part]
    out = G.unsigned_bytes(code) + G.unsigned_bytes(len(points)) + G.unsigned_bytes(len(parts))
    if n_curves:
        out += G.unsigned_bytes(n_curves)
    out += bytes(4) + b"".join(G.unsigned_bytes(len(p)) for p in parts[:-1]) + places(points)
    return out + (deltas(zs) if zs else b"") + ms + curves


SQUARE, HOLE = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]


@pytest.mark.parametrize("value", [0, 1, 63, 64, 127, 128, 300, 2**31, 2**62, 2**63 - 1])
def test_numbers(value):
    assert G.Reader(G.unsigned_bytes(value)).unsigned() == value
    assert G.Reader(G.signed_bytes(value)).signed() == value
    assert G.Reader(G.signed_bytes(-value)).signed() == -value


def test_point():
    blob = G.unsigned_bytes(1) + G.unsigned_bytes(grid(1.5) + 1) + G.unsigned_bytes(grid(-2) + 1)
    g = G.decode_blob(blob, GRID)
    assert g.kind == POINT and G.to_wkt(g, GRID) == "POINT (1.5 -2)"
    z = G.decode_blob(G.unsigned_bytes(11) + blob[1:] + G.unsigned_bytes(151) + G.unsigned_bytes(0), GRID)
    assert G.to_wkt(z, GRID) == "POINT ZM (1.5 -2 1.5 NaN)"
    assert G.decode_blob(G.unsigned_bytes(1) + b"\x00\x05", GRID).status == G.EMPTY
    assert G.to_wkt(G.decode_blob(b"", GRID), GRID) == "POINT EMPTY"


def test_multipoint_and_lines():
    multi = G.unsigned_bytes(8) + G.unsigned_bytes(2) + bytes(4) + places([(1, 2), (3, 4)])
    g = G.decode_blob(multi, GRID)
    assert g.kind == MULTIPOINT and G.to_wkt(g, GRID) == "MULTIPOINT ((1 2), (3 4))"
    lines = G.decode_blob(shape(3, [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 2)]]), GRID)
    assert lines.kind == LINE and G.to_wkt(lines, GRID) == "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 2))"
    z = G.decode_blob(shape(10, [[(0, 0), (1, 1)]], zs=[100, 250]), GRID)
    assert G.to_wkt(z, GRID) == "MULTILINESTRING Z ((0 0 1, 1 1 2.5))"
    assert G.decode_blob(G.unsigned_bytes(3) + b"\x00", GRID).status == G.EMPTY


def test_polygon_rings():
    g = G.decode_blob(shape(5, [HOLE, SQUARE]), GRID)  # the hole comes first and turns the wrong way
    assert g.kind == POLYGON and g.polygons == [(1, [0])]
    assert G.double_area(g.parts[1]) > 0 > G.double_area(g.parts[0])
    assert G.to_wkt(g, GRID) == "MULTIPOLYGON (((0 0, 8 0, 8 8, 0 8, 0 0), (2 6, 6 6, 6 2, 2 2, 2 6)))"
    island = [(3, 3), (4, 3), (4, 4), (3, 4)]
    deep = G.decode_blob(shape(5, [SQUARE, HOLE, island]), GRID)
    assert deep.polygons == [(0, [1]), (2, [])]


@pytest.mark.parametrize("rings", [[[(0, 0), (8, 8), (8, 0), (0, 8)]], [[(0, 0), (1, 1)]], [[(0, 0), (4, 0), (8, 0)]], [SQUARE, [(4, 4), (12, 4), (12, 12), (4, 12)]], [SQUARE, SQUARE]])
def test_bad_rings(rings):
    g = G.decode_blob(shape(5, rings), GRID)
    assert g.status == G.BAD_TOPOLOGY and G.to_wkb(g, GRID) is None


def test_segment_relations():
    v = G.Vertex
    assert G.segment_relation(v(0, 0), v(4, 4), v(0, 4), v(4, 0)) == "cross"
    assert G.segment_relation(v(0, 0), v(4, 0), v(4, 0), v(4, 4)) == "touch"
    assert G.segment_relation(v(0, 0), v(4, 0), v(2, 0), v(9, 0)) == "overlap"
    assert G.segment_relation(v(0, 0), v(4, 0), v(5, 0), v(9, 0)) == "disjoint"
    big = 1 << 62
    assert G.orientation(v(0, 0), v(big, big), v(big, big - 1)) == -1
    ring = [v(0, 0), v(4, 0), v(4, 4), v(0, 4)]
    assert [G.ring_location(v(*p), ring) for p in ((2, 2), (4, 2), (5, 2))] == ["inside", "boundary", "outside"]
    assert G.same_ring(ring, ring[2:] + ring[:2]) and G.same_ring(ring, ring[::-1]) and not G.same_ring(ring, ring[:3])


def curve_bytes(start: int, kind: int, values, flags=None) -> bytes:
    return G.unsigned_bytes(start) + G.unsigned_bytes(kind) + struct.pack(f"<{len(values)}d", *values) + (struct.pack("<I", flags) if flags is not None else b"")


def test_arc_by_centre_and_by_point():
    for values, flags in (((0.0, 0.0), G.ARC_CCW), ((0.0, 10.0), G.ARC_BY_POINT)):
        g = G.decode_blob(shape(50 | G.CURVE_FLAG, [[(10, 0), (-10, 0)]], curves=curve_bytes(0, G.ARC, values, flags), n_curves=1), GRID)
        assert g.was_curve and g.status == G.VALID
        real = [GRID.real(v) for v in g.parts[0]]
        assert len(real) > 36 and all(abs(math.hypot(*p) - 10) < 0.002 for p in real) and real[len(real) // 2][1] > 9.9


def test_bezier_and_ellipse():
    bezier = G.decode_blob(shape(50 | G.CURVE_FLAG, [[(0, 0), (9, 0)]], curves=curve_bytes(0, G.BEZIER, (3, 6, 6, 6)), n_curves=1), GRID)
    top = max(GRID.real(v)[1] for v in bezier.parts[0])
    assert abs(top - 4.5) < 0.01
    ellipse = G.decode_blob(shape(50 | G.CURVE_FLAG, [[(4, 0), (-4, 0)]], curves=curve_bytes(0, G.ELLIPSE, (0, 0, 0, 4, 0.5), G.ELLIPSE_MINOR), n_curves=1), GRID)
    assert all(abs((x / 4) ** 2 + (y / 2) ** 2 - 1) < 0.01 for x, y in (GRID.real(v) for v in ellipse.parts[0]))
    assert G.decode_blob(shape(50 | G.CURVE_FLAG, [[(0, 0), (9, 0)]], curves=curve_bytes(0, 9, ()), n_curves=1), GRID).status == G.INVALID


def test_missing_measures_of_a_curve():
    tail = bytes([G.NO_M_MARKER]) + curve_bytes(0, G.ARC, (0.0, 0.0), G.ARC_CCW)
    g = G.decode_blob(shape(50 | G.CURVE_FLAG | G.M_FLAG, [[(10, 0), (-10, 0)]], curves=tail, n_curves=1), GRID)
    assert g.status == G.VALID and all(math.isnan(v.m) for v in g.parts[0])


def test_curve_that_closes_a_ring():
    g = G.decode_blob(shape(51 | G.CURVE_FLAG, [[(10, 0), (-10, 0), (0, -1)]], curves=curve_bytes(0, G.ARC, (0.0, 0.0), G.ARC_CCW), n_curves=1), GRID)
    assert g.status == G.VALID and len(g.polygons) == 1


def test_wkt_refuses_damage():
    good = G.to_wkb(G.decode_blob(shape(5, [SQUARE]), GRID), GRID)
    assert G.wkb_to_wkt(good + b"\x00") is None
    assert all(G.wkb_to_wkt(good[:n]) is None for n in range(len(good)))
    assert G.wkb_to_wkt(struct.pack("<BI2d", 1, 1, 1.0, math.nan)) is None
    assert G.wkb_to_wkt(struct.pack("<BI", 1, 99)) is None
    assert G.wkb_to_wkt(struct.pack(">BI2d", 0, 1, 1.0, 2.5)) == "POINT (1 2.5)"
    open_ring = struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 1, 0, 1, 1, 5, 5)
    assert G.wkb_to_wkt(open_ring) is None


def test_no_bytes_raise():
    rng = random.Random(11)
    whole = shape(15, [SQUARE, HOLE], zs=list(range(10)), ms=deltas(range(10)))
    for n in range(len(whole)):
        assert G.decode_blob(whole[:n], GRID).status in (G.INVALID, G.EMPTY)
    for _ in range(1000):
        G.decode_blob(rng.randbytes(rng.randint(0, 40)), GRID)
