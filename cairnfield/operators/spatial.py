"""Exact tests of geometries against a closed box, as Column expressions.

A geometry column `gparts` holds parts (of a multipoint: one; of lines: the lines; of polygons: all
rings, holes included) as arrays of (x, y). `gbox` is its envelope, written beside it so that Parquet
can skip row groups; envelope tests come first, and what lies wholly inside the box needs no other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnfield.errors import Code, EngineError

POINT, MULTIPOINT, LINE, POLYGON = "point", "multipoint", "line", "polygon"


@dataclass(frozen=True)
class Box:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def __post_init__(self) -> None:
        sides = (self.xmin, self.ymin, self.xmax, self.ymax)
        if any(math.isnan(s) for s in sides) or self.xmin > self.xmax or self.ymin > self.ymax:
            raise EngineError(Code.INVALID_REQUEST, "box is inverted or not a number")


def _fold(parts: list[Column], every: bool) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p if every else out | p
    return out


def envelope_meets(gbox: Column, box: Box) -> Column:
    """Range conditions on the envelope's own fields, which reach the scan."""
    return _fold([gbox["xmin"] <= box.xmax, gbox["xmax"] >= box.xmin, gbox["ymin"] <= box.ymax, gbox["ymax"] >= box.ymin], True)


def envelope_inside(gbox: Column, box: Box) -> Column:
    return _fold([gbox["xmin"] >= box.xmin, gbox["xmax"] <= box.xmax, gbox["ymin"] >= box.ymin, gbox["ymax"] <= box.ymax], True)


def point_inside(x: Column, y: Column, box: Box) -> Column:
    return _fold([x >= box.xmin, x <= box.xmax, y >= box.ymin, y <= box.ymax], True)


def segment_meets(a: Column, b: Column, box: Box) -> Column:
    """A segment meets a box if neither an axis nor the normal of the segment parts them."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = [dx * (cy - a["y"]) - dy * (cx - a["x"]) for cx in (box.xmin, box.xmax) for cy in (box.ymin, box.ymax)]
    parted = _fold([s > 0 for s in sides], True) | _fold([s < 0 for s in sides], True)
    overlap = _fold(
        [F.least(a["x"], b["x"]) <= box.xmax, F.greatest(a["x"], b["x"]) >= box.xmin, F.least(a["y"], b["y"]) <= box.ymax, F.greatest(a["y"], b["y"]) >= box.ymin],
        True,
    )
    return overlap & ~parted


def _pairs(points: Column, closed: bool) -> Column:
    """Neighbouring points as (a, b); closed: the last and the first too."""
    n = F.size(points)
    if closed:
        return F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    short = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, short), F.slice(points, 2, short), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def any_point_inside(parts: Column, box: Box) -> Column:
    return F.exists(parts, lambda part: F.exists(part, lambda p: point_inside(p["x"], p["y"], box)))


def any_segment_meets(parts: Column, box: Box, closed: bool = False) -> Column:
    """A part of one point is met where the point is."""
    return F.exists(parts, lambda part: F.exists(_pairs(part, closed), lambda s: segment_meets(s["a"], s["b"], box)) | F.exists(part, lambda p: point_inside(p["x"], p["y"], box)))


def crossings(ring: Column, x: float, y: float) -> Column:
    """Edges of the ring that a ray from (x, y) to the right crosses."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        level = (a["y"] > y) != (b["y"] > y)
        # the side of the upward edge, without a division
        side = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        return level & F.when(b["y"] > a["y"], side > 0).otherwise(side < 0)

    return F.size(F.filter(_pairs(ring, True), crossed))


def point_in_polygon(rings: Column, x: float, y: float) -> Column:
    """By the even-odd rule over all rings, so holes are outside; points on an edge are not decided here."""
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring, x, y)) % 2 == 1


def polygon_meets(rings: Column, box: Box) -> Column:
    """An edge meets the box or, where none does, the box's lower left corner lies in the polygon."""
    return any_segment_meets(rings, box, closed=True) | point_in_polygon(rings, box.xmin, box.ymin)


def meets(kind: str, box: Box, gbox: Column, parts: Column | None = None) -> Column:
    """The whole test for geometries of a kind."""
    touching = envelope_meets(gbox, box)
    if kind == POINT:
        return touching
    if parts is None:
        raise EngineError(Code.UNSUPPORTED, "the layer has no geometry parts")
    exact = {MULTIPOINT: lambda: any_point_inside(parts, box), LINE: lambda: any_segment_meets(parts, box), POLYGON: lambda: polygon_meets(parts, box)}[kind]()
    return touching & F.when(envelope_inside(gbox, box), True).otherwise(exact)


def meets_by_kind(kind: Column, box: Box, gbox: Column, parts: Column) -> Column:
    """The whole test where each row names its kind; rows without parts are met by their envelope."""
    exact = F.when(envelope_inside(gbox, box) | parts.isNull(), True)
    for name, test in ((MULTIPOINT, any_point_inside(parts, box)), (LINE, any_segment_meets(parts, box)), (POLYGON, polygon_meets(parts, box))):
        exact = exact.when(kind == name, test)
    return envelope_meets(gbox, box) & exact.otherwise(True)


def envelope(parts: Column) -> Column:
    """gbox of parts, null where there is no point."""
    points = F.flatten(parts)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")))


def point_envelope(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax")))


def signed_area(ring: Column) -> Column:
    """Shoelace sum about the ring's first point; counter-clockwise is positive."""
    first = F.element_at(ring, 1)
    twice = F.aggregate(
        _pairs(ring, True),
        F.lit(0.0),
        lambda total, s: total + (s["a"]["x"] - first["x"]) * (s["b"]["y"] - first["y"]) - (s["b"]["x"] - first["x"]) * (s["a"]["y"] - first["y"]),
    )
    return F.when(F.size(ring) > 0, twice / 2)


def coverage(box: Box, extent: Box) -> float:
    """Share of the extent's area under the box, from 0 to 1; an extent without area counts as covered if met."""
    width, height = min(box.xmax, extent.xmax) - max(box.xmin, extent.xmin), min(box.ymax, extent.ymax) - max(box.ymin, extent.ymin)
    if width < 0 or height < 0:
        return 0.0
    area = (extent.xmax - extent.xmin) * (extent.ymax - extent.ymin)
    return min(1.0, max(0.0, width * height / area)) if area > 0 else 1.0


def relation(kind: str, name: str, box: Box, gbox: Column, parts: Column | None = None) -> Column:
    """intersects, within (the geometry in the box), contains (the box in a polygon) or disjoint; a null geometry is disjoint alone."""
    hit = meets(kind, box, gbox, parts)
    if name == "intersects":
        return hit
    if name == "disjoint":
        return gbox.isNull() | ~hit
    if name == "within":
        return envelope_inside(gbox, box)
    if name == "contains":
        if kind != POLYGON:
            return F.lit(False)
        inner = Box(box.xmin, box.ymin, box.xmax, box.ymax)
        crossed = F.exists(parts, lambda r: F.exists(_pairs(r, True), lambda s: segment_meets(s["a"], s["b"], inner)))
        return envelope_meets(gbox, box) & ~crossed & point_in_polygon(parts, box.xmin, box.ymin)
    raise EngineError(Code.INVALID_REQUEST, f"unknown relation {name}")
