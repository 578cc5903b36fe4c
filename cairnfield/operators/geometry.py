"""Geometry codecs: blobs on an integer grid, ISO WKB, WKT, polygon topology and curves.

Pure Python on one geometry; Spark runs them in Arrow batches (`with_wkb`, `with_wkt`, `with_decoded`).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.operators.spatial import LINE, MULTIPOINT, POINT, POLYGON

VALID, EMPTY, NULL = "valid", "empty", "null"
INVALID, OVERFLOW, UNSUPPORTED, BAD_TOPOLOGY = "invalid encoding", "numeric overflow", "unsupported type", "invalid topology"
INT64_MAX = (1 << 63) - 1

# ISO WKB numbers of the kinds; single-part lines and polygons are written as their multi kinds.
WKB_POINT, WKB_LINE, WKB_POLYGON, WKB_MULTIPOINT, WKB_MULTILINE, WKB_MULTIPOLYGON = 1, 2, 3, 4, 5, 6
WKT_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}

# Type codes of geometry blobs.
POINT_CODES = frozenset((1, 9, 11, 21, 52))
MULTIPOINT_CODES = frozenset((8, 18, 20, 28, 53))
LINE_CODES = frozenset((3, 10, 13, 23, 50))
POLYGON_CODES = frozenset((5, 15, 19, 25, 51))
MULTIPATCH_CODES = frozenset((31, 32, 54))
Z_CODES = frozenset((9, 10, 11, 13, 15, 18, 19, 20, 31, 32))
M_CODES = frozenset((11, 13, 15, 18, 21, 23, 25, 28, 31))
GENERAL_FROM, Z_FLAG, M_FLAG, CURVE_FLAG = 50, 0x80000000, 0x40000000, 0x20000000
NO_M_MARKER = 0x42


@dataclass(frozen=True)
class Grid:
    """real = grid / scale + origin; a scale of zero is the origin alone."""

    x_origin: float = 0.0
    y_origin: float = 0.0
    xy_scale: float = 1.0
    z_origin: float = 0.0
    z_scale: float = 1.0
    m_origin: float = 0.0
    m_scale: float = 1.0
    has_z: bool = False
    has_m: bool = False

    def real(self, p: Vertex) -> tuple[float, float]:
        return p.x / self.xy_scale + self.x_origin, p.y / self.xy_scale + self.y_origin


@dataclass(frozen=True)
class Vertex:
    """A place on the integer grid; z and m are real."""

    x: int
    y: int
    z: float = 0.0
    m: float = 0.0


@dataclass
class Geometry:
    """parts: points of a multipoint, lines, or rings; polygons: (outer ring, holes) by ring number."""

    kind: str = POINT
    status: str = VALID
    diagnostic: str = ""
    has_z: bool = False
    has_m: bool = False
    was_curve: bool = False
    parts: list[list[Vertex]] = field(default_factory=list)
    polygons: list[tuple[int, list[int]]] = field(default_factory=list)


class BlobError(Exception):
    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


class Reader:
    """Cursor over bytes that never reads past the end."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise BlobError(INVALID, "truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def unpack(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def real(self) -> float:
        value = self.unpack("d")
        if not math.isfinite(value):
            raise BlobError(INVALID, "number is not finite")
        return value

    def unsigned(self) -> int:
        """Seven bits a byte, low ones first, at most 64 in all."""
        value = shift = 0
        while True:
            byte = self.byte()
            value |= (byte & 0x7F) << shift
            if value >> 64:
                raise BlobError(INVALID, "number is too long")
            if not byte & 0x80:
                return value
            shift += 7
            if shift > 63:
                raise BlobError(INVALID, "number is too long")

    def signed(self) -> int:
        """Like unsigned, with the sign in the second bit of the first byte."""
        byte = self.byte()
        sign, value, shift = -1 if byte & 0x40 else 1, byte & 0x3F, 6
        while byte & 0x80:
            byte = self.byte()
            value |= (byte & 0x7F) << shift
            shift += 7
            if value > INT64_MAX:
                raise BlobError(INVALID, "number is too long")
        return sign * value


def unsigned_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def signed_bytes(value: int) -> bytes:
    size = abs(value)
    first = size & 0x3F | (0x40 if value < 0 else 0)
    size >>= 6
    return bytes([first | 0x80]) + unsigned_bytes(size) if size else bytes([first])


def _scaled(raw: int, origin: float, scale: float) -> float:
    return origin if scale == 0 else raw / scale + origin


def _deltas(reader: Reader, n: int) -> list[int]:
    out, value = [], 0
    for _ in range(n):
        value += reader.signed()
        if not -INT64_MAX - 1 <= value <= INT64_MAX:
            raise BlobError(INVALID, "coordinate overflows")
        out.append(value)
    return out


def _places(reader: Reader, n: int) -> list[tuple[int, int]]:
    if n > (reader.end - reader.at) // 2:
        raise BlobError(INVALID, "truncated coordinates")
    both = []
    x = y = 0
    for _ in range(n):
        x, y = x + reader.signed(), y + reader.signed()
        if max(abs(x), abs(y)) > INT64_MAX:
            raise BlobError(INVALID, "coordinate overflows")
        both.append((x, y))
    return both


def decode_blob(blob: bytes | None, grid: Grid, linearize: bool = True) -> Geometry:
    """A blob of any bytes as a geometry; damage gives a status, never an exception."""
    if not blob:
        return Geometry(status=EMPTY, diagnostic="empty geometry blob")
    out = Geometry()
    try:
        _decode(Reader(blob), grid, out, linearize)
    except BlobError as error:
        out.status, out.diagnostic, out.parts, out.polygons = error.status, str(error), [], []
    return out


def _decode(reader: Reader, grid: Grid, out: Geometry, linearize: bool) -> None:
    code = reader.unsigned()
    base = code & 0xFF
    general = base >= GENERAL_FROM
    out.has_z = bool(code & Z_FLAG) if general else grid.has_z or base in Z_CODES
    out.has_m = bool(code & M_FLAG) if general else grid.has_m or base in M_CODES
    if base == 0:
        out.status = EMPTY
    elif base in POINT_CODES:
        _decode_point(reader, grid, out)
    elif base in MULTIPOINT_CODES:
        out.kind = MULTIPOINT
        n = reader.unsigned()
        if not n:
            out.status = EMPTY
            return
        for _ in range(4):
            reader.unsigned()
        places = _places(reader, n)
        zs = _deltas(reader, n) if out.has_z else None
        ms = _deltas(reader, n) if out.has_m else None
        out.parts = [_vertices(places, zs, ms, grid)]
    elif base in LINE_CODES or base in POLYGON_CODES:
        out.kind = POLYGON if base in POLYGON_CODES else LINE
        _decode_parts(reader, grid, out, base in (50, 51) and bool(code & CURVE_FLAG), linearize)
    else:
        raise BlobError(UNSUPPORTED, f"geometry type {base}")


def _vertices(places: list[tuple[int, int]], zs: list[int] | None, ms: list[int] | None, grid: Grid) -> list[Vertex]:
    return [
        Vertex(x, y, _scaled(zs[i], grid.z_origin, grid.z_scale) if zs else 0.0, _scaled(ms[i], grid.m_origin, grid.m_scale) if ms else 0.0)
        for i, (x, y) in enumerate(places)
    ]


def _decode_point(reader: Reader, grid: Grid, out: Geometry) -> None:
    """Coordinates are one more than on the grid; zero means there is none."""
    x, y = reader.unsigned(), reader.unsigned()
    if not x or not y:
        out.status = EMPTY
        return
    if max(x, y) - 1 > INT64_MAX:
        raise BlobError(OVERFLOW, "point lies off the grid")

    def ordinate(origin: float, scale: float) -> float:
        raw = reader.unsigned()
        return math.nan if not raw else _scaled(raw - 1, origin, scale)

    z = ordinate(grid.z_origin, grid.z_scale) if out.has_z else 0.0
    m = ordinate(grid.m_origin, grid.m_scale) if out.has_m else 0.0
    out.parts = [[Vertex(x - 1, y - 1, z, m)]]


def _decode_parts(reader: Reader, grid: Grid, out: Geometry, curved: bool, linearize: bool) -> None:
    n = reader.unsigned()
    if not n:
        out.status = EMPTY
        return
    n_parts = reader.unsigned()
    n_curves = reader.unsigned() if curved else 0
    out.was_curve = n_curves > 0
    for _ in range(4):
        reader.unsigned()
    if not 0 < n_parts <= n:
        raise BlobError(INVALID, "impossible number of parts")
    sizes = [reader.unsigned() for _ in range(n_parts - 1)]
    sizes.append(n - sum(sizes))
    if min(sizes) < 1:
        raise BlobError(INVALID, "impossible part sizes")
    places = _places(reader, n)
    zs = _deltas(reader, n) if out.has_z else None
    curves: list[Curve] = []
    ms: list[int] | None = None
    missing_m = False
    if n_curves:
        tail = reader.at
        try:
            ms = _deltas(reader, n) if out.has_m else None
            curves = _curves(reader, n_curves, n)
        except BlobError:
            # a curve without M in a layer with M: one marker byte stands for all its measures
            reader.at = tail
            if not out.has_m or reader.byte() != NO_M_MARKER:
                raise
            ms, missing_m, curves = None, True, _curves(reader, n_curves, n)
            if reader.at != reader.end:
                raise BlobError(INVALID, "bytes after the curves") from None
    elif out.has_m:
        ms = _deltas(reader, n)
    vertices = _vertices(places, zs, ms, grid)
    if missing_m:
        vertices = [replace(v, m=math.nan) for v in vertices]
    parts, at = [], 0
    for size in sizes:
        part = vertices[at : at + size]
        own = {c.start - at: c for c in curves if at <= c.start < at + size}
        if own and not linearize:
            raise BlobError(UNSUPPORTED, "curves are not wanted")
        parts.append(linear_part(part, own, grid, out.kind == POLYGON) if own else part)
        at += size
    out.parts = parts
    if out.kind == POLYGON:
        arrange_rings(out)


def peek_envelope(blob: bytes | None, grid: Grid) -> tuple[float, float, float, float] | None:
    """Envelope from a blob's head alone, also of kinds that are not decoded; None where there is none."""
    if not blob:
        return None
    reader = Reader(blob)
    try:
        code = reader.unsigned()
        base = code & 0xFF
        if base in POINT_CODES:
            x, y = reader.unsigned(), reader.unsigned()
            if not x or not y:
                return None
            px, py = grid.real(Vertex(x - 1, y - 1))
            return px, py, px, py
        if base not in MULTIPOINT_CODES | LINE_CODES | POLYGON_CODES | MULTIPATCH_CODES or not reader.unsigned():
            return None
        if base in MULTIPATCH_CODES:
            reader.unsigned()  # bytes of the body
        if base not in MULTIPOINT_CODES:
            reader.unsigned()
        if base in (50, 51) and code & CURVE_FLAG:
            reader.unsigned()
        x, y, width, height = (reader.unsigned() for _ in range(4))
    except BlobError:
        return None
    (x0, y0), (x1, y1) = grid.real(Vertex(x, y)), grid.real(Vertex(x + width, y + height))
    return x0, y0, x1, y1


# --- curves ---------------------------------------------------------------------------------------

# Kinds of curve descriptors and flags of arcs.
ARC, BEZIER, ELLIPSE = 1, 4, 5
ARC_EMPTY, ARC_CCW, ARC_LINE, ARC_POINT, ARC_BY_POINT = 0x01, 0x08, 0x20, 0x40, 0x80
ELLIPSE_LINE, ELLIPSE_POINT, ELLIPSE_TO, ELLIPSE_FROM, ELLIPSE_MINOR, ELLIPSE_WHOLE = 0x40, 0x80, 0x200, 0x400, 0x1000, 0x2000
MAX_SEGMENTS, ANGLE_STEP, MAX_DEPTH = 4096, math.radians(5.0), 24


@dataclass(frozen=True)
class Curve:
    start: int
    kind: int
    values: tuple[float, ...]
    flags: int = 0


def _curves(reader: Reader, count: int, n: int) -> list[Curve]:
    out: list[Curve] = []
    for _ in range(count):
        start, kind = reader.unsigned(), reader.unsigned()
        if start >= n - 1 or out and start <= out[-1].start:
            raise BlobError(INVALID, "curves out of order")
        size = {ARC: 2, BEZIER: 4, ELLIPSE: 5}.get(kind)
        if size is None:
            raise BlobError(INVALID, "unknown curve")
        values = [reader.real() for _ in range(size)]
        if kind == ELLIPSE:
            values[2] = -values[2]  # stored clockwise
        out.append(Curve(start, kind, tuple(values), reader.unpack("I") if kind != BEZIER else 0))
    return out


def _steps(sweep: float, radius: float, error: float) -> int:
    """Segments of an arc: 5 degrees at most, and no chord farther from the arc than error."""
    step = ANGLE_STEP
    if 0 < error < radius:
        step = min(step, 2 * math.acos(max(-1.0, 1 - error / radius)))
    return max(1, min(MAX_SEGMENTS, math.ceil(abs(sweep) / step)))


def _arc_sweep(start: float, end: float, ccw: bool) -> float:
    turn = (end - start) % (2 * math.pi)
    return turn if ccw else turn - 2 * math.pi if turn else 0.0


def arc_points(a: tuple[float, float], b: tuple[float, float], curve: Curve, error: float) -> list[tuple[float, float]]:
    """Points of a circular arc between its ends, which are left out."""
    if curve.flags & (ARC_EMPTY | ARC_POINT):
        raise BlobError(INVALID, "arc without a curve")
    if curve.flags & ARC_LINE:
        return []
    px, py = curve.values
    whole = a == b
    if curve.flags & ARC_BY_POINT:
        if whole:  # the point lies opposite
            cx, cy, sweep = (a[0] + px) / 2, (a[1] + py) / 2, 2 * math.pi
        else:
            d = 2 * (a[0] * (py - b[1]) + px * (b[1] - a[1]) + b[0] * (a[1] - py))
            if d == 0:
                return []
            sa, sp, sb = a[0] ** 2 + a[1] ** 2, px**2 + py**2, b[0] ** 2 + b[1] ** 2
            cx = (sa * (py - b[1]) + sp * (b[1] - a[1]) + sb * (a[1] - py)) / d
            cy = (sa * (b[0] - px) + sp * (a[0] - b[0]) + sb * (px - a[0])) / d
            cross = (px - a[0]) * (b[1] - a[1]) - (py - a[1]) * (b[0] - a[0])
            sweep = _arc_sweep(math.atan2(a[1] - cy, a[0] - cx), math.atan2(b[1] - cy, b[0] - cx), cross > 0)
    else:
        cx, cy = px, py
        ccw = bool(curve.flags & ARC_CCW)
        sweep = (2 * math.pi if ccw else -2 * math.pi) if whole else _arc_sweep(math.atan2(a[1] - cy, a[0] - cx), math.atan2(b[1] - cy, b[0] - cx), ccw)
    radius, begin = math.hypot(a[0] - cx, a[1] - cy), math.atan2(a[1] - cy, a[0] - cx)
    n = _steps(sweep, radius, error)
    return [(cx + radius * math.cos(begin + sweep * k / n), cy + radius * math.sin(begin + sweep * k / n)) for k in range(1, n)]


def bezier_points(a: tuple[float, float], b: tuple[float, float], curve: Curve, error: float) -> list[tuple[float, float]]:
    """Points of a cubic between its ends; halves are split until the controls lie within error of the chord."""
    out: list[tuple[float, float]] = []
    mid = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)

    def off(p: tuple[float, float], s: tuple[float, float], e: tuple[float, float]) -> float:
        length = math.hypot(e[0] - s[0], e[1] - s[1])
        if length == 0:
            return math.hypot(p[0] - s[0], p[1] - s[1])
        return abs((e[0] - s[0]) * (p[1] - s[1]) - (e[1] - s[1]) * (p[0] - s[0])) / length

    def split(p0, p1, p2, p3, depth: int) -> None:
        if depth >= MAX_DEPTH or len(out) >= MAX_SEGMENTS or max(off(p1, p0, p3), off(p2, p0, p3)) <= error:
            return
        p01, p12, p23 = mid(p0, p1), mid(p1, p2), mid(p2, p3)
        p012, p123 = mid(p01, p12), mid(p12, p23)
        centre = mid(p012, p123)
        split(p0, p01, p012, centre, depth + 1)
        out.append(centre)
        split(centre, p123, p23, p3, depth + 1)

    split(a, curve.values[0:2], curve.values[2:4], b, 0)
    return out


def ellipse_points(a: tuple[float, float], b: tuple[float, float], curve: Curve, error: float) -> list[tuple[float, float]]:
    """Points of an elliptic arc (centre, rotation, semi-major axis, ratio) between its ends."""
    if curve.flags & (ELLIPSE_POINT | ELLIPSE_TO | ELLIPSE_FROM):
        raise BlobError(UNSUPPORTED, "elliptic arc is not given by its centre")
    if curve.flags & ELLIPSE_LINE:
        return []
    cx, cy, turn = curve.values[:3]
    major = abs(curve.values[3])
    minor = major * abs(curve.values[4])
    if major <= 0 or minor <= 0:
        raise BlobError(INVALID, "ellipse without axes")
    cos, sin = math.cos(turn), math.sin(turn)

    def angle(p: tuple[float, float]) -> float:
        dx, dy = p[0] - cx, p[1] - cy
        return math.atan2((dy * cos - dx * sin) / minor, (dx * cos + dy * sin) / major)

    begin = angle(a)
    if curve.flags & ELLIPSE_WHOLE:
        sweep = -2 * math.pi
    else:
        short = (angle(b) - begin) % (2 * math.pi)
        short -= 2 * math.pi if short > math.pi else 0
        long = short - 2 * math.pi if short >= 0 else short + 2 * math.pi
        sweep = short if curve.flags & ELLIPSE_MINOR else long
    n = _steps(sweep, max(major, minor), error)
    out = []
    for k in range(1, n):
        t = begin + sweep * k / n
        u, v = major * math.cos(t), minor * math.sin(t)
        out.append((cx + u * cos - v * sin, cy + u * sin + v * cos))
    return out


_SAMPLERS = {ARC: arc_points, BEZIER: bezier_points, ELLIPSE: ellipse_points}


def linear_part(part: list[Vertex], curves: dict[int, Curve], grid: Grid, closed: bool) -> list[Vertex]:
    """The part with every curved segment replaced by points on the grid; z and m run evenly along it."""
    error = 0.25 / abs(grid.xy_scale) if grid.xy_scale else 1e-9
    out: list[Vertex] = []

    def add(v: Vertex) -> None:
        if not out or out[-1] != v:
            out.append(v)

    for i, v in enumerate(part):
        add(v)
        curve = curves.get(i)
        if curve is None:
            continue
        after = part[i + 1] if i + 1 < len(part) else part[0] if closed else None
        if after is None:
            raise BlobError(INVALID, "curve without an end")
        points = _SAMPLERS[curve.kind](grid.real(v), grid.real(after), curve, error)
        for k, (x, y) in enumerate(points, 1):
            if not math.isfinite(x) or not math.isfinite(y):
                raise BlobError(OVERFLOW, "curve leaves the grid")
            t = k / (len(points) + 1)
            gx, gy = round((x - grid.x_origin) * grid.xy_scale), round((y - grid.y_origin) * grid.xy_scale)
            add(Vertex(gx, gy, v.z + (after.z - v.z) * t, v.m + (after.m - v.m) * t))
    return out


# --- polygon topology, exact on the grid ----------------------------------------------------------


def orientation(a: Vertex, b: Vertex, c: Vertex) -> int:
    """Sign of the turn; Python integers do not overflow."""
    turn = (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)
    return (turn > 0) - (turn < 0)


def double_area(ring: list[Vertex]) -> int:
    return sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _on_segment(p: Vertex, a: Vertex, b: Vertex) -> bool:
    return min(a.x, b.x) <= p.x <= max(a.x, b.x) and min(a.y, b.y) <= p.y <= max(a.y, b.y) and orientation(a, b, p) == 0


def segment_relation(a: Vertex, b: Vertex, c: Vertex, d: Vertex) -> str:
    """disjoint, touch (an end on the other), cross or overlap (a common stretch)."""
    o = [orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)]
    if o[0] * o[1] < 0 and o[2] * o[3] < 0:
        return "cross"
    if not any(o):
        along = (lambda p: (p.x, p.y))
        low, high = max(min(along(a), along(b)), min(along(c), along(d))), min(max(along(a), along(b)), max(along(c), along(d)))
        return "overlap" if low < high else "touch" if low == high else "disjoint"
    if _on_segment(c, a, b) or _on_segment(d, a, b) or _on_segment(a, c, d) or _on_segment(b, c, d):
        return "touch"
    return "disjoint"


def ring_location(p: Vertex, ring: list[Vertex]) -> str:
    """inside, outside or boundary, by the even-odd rule."""
    inside = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if _on_segment(p, a, b):
            return "boundary"
        if (a.y > p.y) != (b.y > p.y) and (orientation(a, b, p) > 0) == (b.y > a.y):
            inside = not inside
    return "inside" if inside else "outside"


def same_ring(left: list[Vertex], right: list[Vertex]) -> bool:
    """Equal but for the first vertex and the direction."""
    if len(left) != len(right):
        return False
    a, b = [(v.x, v.y) for v in left], [(v.x, v.y) for v in right]
    return not a or any(c[k:] + c[:k] == a for c in (b, b[::-1]) for k in range(len(c)))


def _cleaned(ring: list[Vertex]) -> list[Vertex]:
    out: list[Vertex] = []
    for v in ring:
        if not out or (out[-1].x, out[-1].y) != (v.x, v.y):
            out.append(v)
    while len(out) > 1 and (out[0].x, out[0].y) == (out[-1].x, out[-1].y):
        out.pop()
    return out


def _box(ring: list[Vertex]) -> tuple[int, int, int, int]:
    xs, ys = [v.x for v in ring], [v.y for v in ring]
    return min(xs), min(ys), max(xs), max(ys)


def _edges(ring: list[Vertex]) -> list[tuple[Vertex, Vertex]]:
    return list(zip(ring, ring[1:] + ring[:1], strict=True))


def _self_fault(ring: list[Vertex]) -> str | None:
    """Neighbouring edges share an end; all else that meets is a fault. Edges are swept by x, so only near ones are compared."""
    edges = _edges(ring)
    n = len(edges)
    order = sorted(range(n), key=lambda i: min(edges[i][0].x, edges[i][1].x))
    active: list[int] = []
    for i in order:
        low = min(edges[i][0].x, edges[i][1].x)
        active = [j for j in active if max(edges[j][0].x, edges[j][1].x) >= low]
        for j in active:
            found = segment_relation(*edges[i], *edges[j])
            if found == "disjoint" or found == "touch" and (abs(i - j) == 1 or abs(i - j) == n - 1):
                continue
            return "self-touching" if found == "touch" else "self-crossing"
        active.append(i)
    return None


def arrange_rings(out: Geometry) -> None:
    """Checks the rings, finds which lie in which, and orients outer rings counter-clockwise, holes clockwise."""
    rings = [_cleaned(r) for r in out.parts]
    for k, ring in enumerate(rings):
        fault = "has fewer than three vertices" if len(ring) < 3 else None
        fault = fault or ((s := _self_fault(ring)) and f"is {s}") or ("has no area" if double_area(ring) == 0 else None)
        if fault:
            raise BlobError(BAD_TOPOLOGY, f"ring {k} {fault}")
    boxes = [_box(r) for r in rings]
    for i in range(len(rings)):
        for j in range(i + 1, len(rings)):
            (a0, b0, a1, b1), (c0, d0, c1, d1) = boxes[i], boxes[j]
            if a0 > c1 or c0 > a1 or b0 > d1 or d0 > b1:
                continue
            if same_ring(rings[i], rings[j]):
                raise BlobError(BAD_TOPOLOGY, f"rings {i} and {j} are equal")
            near = lambda e: min(e[0].x, e[1].x) <= min(a1, c1) and max(e[0].x, e[1].x) >= max(a0, c0)  # noqa: E731, B023
            if any(segment_relation(*e, *f) in ("cross", "overlap") for e in filter(near, _edges(rings[i])) for f in filter(near, _edges(rings[j]))):
                raise BlobError(BAD_TOPOLOGY, f"rings {i} and {j} cross")
    areas = [abs(double_area(r)) for r in rings]

    def lies_in(child: int, ring: int) -> bool:
        """By the first vertex that is not on the other's edge."""
        for v in rings[child]:
            place = ring_location(v, rings[ring])
            if place != "boundary":
                return place == "inside"
        return False

    parents = []
    for i in range(len(rings)):
        holders = [j for j in range(len(rings)) if j != i and areas[j] > areas[i] and lies_in(i, j)]
        parents.append(min(holders, key=areas.__getitem__, default=-1))
    depth = []
    for i in range(len(rings)):
        d, at = 0, parents[i]
        while at >= 0:
            d, at = d + 1, parents[at]
        depth.append(d)
    for i, ring in enumerate(rings):
        if (double_area(ring) > 0) != (depth[i] % 2 == 0):
            rings[i] = ring[::-1]
    out.parts = rings
    out.polygons = [(i, [j for j in range(len(rings)) if parents[j] == i]) for i in range(len(rings)) if depth[i] % 2 == 0]


# --- WKB and WKT ----------------------------------------------------------------------------------


def _head(kind: int, has_z: bool, has_m: bool) -> bytes:
    return struct.pack("<BI", 1, kind + (1000 if has_z else 0) + (2000 if has_m else 0))


def to_wkb(g: Geometry, grid: Grid) -> bytes | None:
    """ISO WKB, little-endian; rings are closed, an empty point is NaN, other empty geometries have no parts."""
    if g.status not in (VALID, EMPTY):
        return None
    dims = g.has_z, g.has_m

    def place(v: Vertex) -> bytes:
        return struct.pack(f"<{2 + g.has_z + g.has_m}d", *grid.real(v), *([v.z] if g.has_z else []), *([v.m] if g.has_m else []))

    def run(points: list[Vertex]) -> bytes:
        return struct.pack("<I", len(points)) + b"".join(map(place, points))

    if g.kind == POINT:
        width = 2 + g.has_z + g.has_m
        return _head(WKB_POINT, *dims) + (place(g.parts[0][0]) if g.parts else struct.pack(f"<{width}d", *[math.nan] * width))
    if g.kind == MULTIPOINT:
        points = g.parts[0] if g.parts else []
        return _head(WKB_MULTIPOINT, *dims) + struct.pack("<I", len(points)) + b"".join(_head(WKB_POINT, *dims) + place(v) for v in points)
    if g.kind == LINE:
        return _head(WKB_MULTILINE, *dims) + struct.pack("<I", len(g.parts)) + b"".join(_head(WKB_LINE, *dims) + run(p) for p in g.parts)
    bodies = []
    for outer, holes in g.polygons:
        rings = [g.parts[k] for k in (outer, *holes)]
        bodies.append(_head(WKB_POLYGON, *dims) + struct.pack("<I", len(rings)) + b"".join(run([*r, r[0]]) for r in rings))
    return _head(WKB_MULTIPOLYGON, *dims) + struct.pack("<I", len(bodies)) + b"".join(bodies)


def _number(value: float) -> str:
    return "NaN" if math.isnan(value) else f"{value:.15g}"


def wkb_to_wkt(wkb: bytes | None) -> str | None:
    """WKT of ISO WKB of either byte order; None for anything damaged, unknown or with bytes left over."""
    if not wkb:
        return None
    try:
        text, at = _wkt_of(wkb, 0, True)
    except (struct.error, ValueError, IndexError):
        return None
    return text if at == len(wkb) else None


def _wkt_of(wkb: bytes, at: int, named: bool, expect: int | None = None, dims: str | None = None) -> tuple[str, int]:
    order = {0: ">", 1: "<"}.get(wkb[at])
    if order is None:
        raise ValueError("byte order")
    code = struct.unpack_from(order + "I", wkb, at + 1)[0]
    at += 5
    suffix = {0: "", 1: " Z", 2: " M", 3: " ZM"}.get(code // 1000)
    kind = code % 1000
    if suffix is None or kind not in WKT_NAMES or expect not in (None, kind) or dims not in (None, suffix):
        raise ValueError("type")
    width = 2 + len(suffix.strip())

    def count(least: int) -> int:
        nonlocal at
        n = struct.unpack_from(order + "I", wkb, at)[0]
        at += 4
        if n * least > len(wkb) - at:
            raise ValueError("count")
        return n

    def place() -> tuple[float, ...]:
        nonlocal at
        values = struct.unpack_from(f"{order}{width}d", wkb, at)
        at += 8 * width
        return values

    def run(n: int) -> tuple[str, list[tuple[float, ...]]]:
        points = [place() for _ in range(n)]
        return "(" + ", ".join(" ".join(map(_number, p)) for p in points) + ")", points

    if kind == WKB_POINT:
        p = place()
        if math.isnan(p[0]) != math.isnan(p[1]):
            raise ValueError("half a point")
        body = "EMPTY" if math.isnan(p[0]) else "(" + " ".join(map(_number, p)) + ")"
    elif kind == WKB_LINE:
        n = count(8 * width)
        body = run(n)[0] if n else "EMPTY"
    elif kind == WKB_POLYGON:
        rings = []
        for _ in range(count(4)):
            text, points = run(count(8 * width))
            if len(points) < 4 or points[0] != points[-1]:
                raise ValueError("ring is open")
            rings.append(text)
        body = "(" + ", ".join(rings) + ")" if rings else "EMPTY"
    else:
        inner = []
        for _ in range(count(5)):
            text, at = _wkt_of(wkb, at, False, kind - 3, suffix)
            inner.append(text)
        body = "(" + ", ".join(inner) + ")" if inner else "EMPTY"
    return (f"{WKT_NAMES[kind]}{suffix} {body}" if named else body), at


def to_wkt(g: Geometry, grid: Grid) -> str | None:
    return wkb_to_wkt(to_wkb(g, grid))


# --- Spark ----------------------------------------------------------------------------------------

GEOM = T.StructType(
    [
        T.StructField("wkb", T.BinaryType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("has_z", T.BooleanType()),
        T.StructField("has_m", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("diagnostic", T.StringType()),
        T.StructField("was_curve", T.BooleanType()),
    ]
)


def point_wkb(x: Column, y: Column) -> Column:
    """WKB of points, in Arrow batches."""

    @F.arrow_udf(T.BinaryType())
    def pack(xs: pa.Array, ys: pa.Array) -> pa.Array:
        at = [np.asarray(c.fill_null(math.nan)) for c in (xs, ys)]
        whole = np.empty(len(xs), np.dtype([("head", "V5"), ("x", "<f8"), ("y", "<f8")]))
        whole["head"], whole["x"], whole["y"] = np.void(_head(WKB_POINT, False, False)), at[0], at[1]
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(whole.itemsize), len(whole), [None, pa.py_buffer(whole.tobytes())]).cast(pa.binary())
        return pc.if_else(pa.array(np.isnan(at[0]) | np.isnan(at[1])), pa.scalar(None, pa.binary()), fixed)

    return pack(x.cast("double"), y.cast("double"))


def _real_geometry(kind: str, parts: list[list[dict[str, float]]] | None) -> Geometry:
    """A geometry of real coordinates: each coordinate's rank would do for topology, so the grid is that of exact fractions."""
    if parts is None:
        return Geometry(kind, NULL)
    if not any(parts):
        return Geometry(kind, EMPTY)
    return Geometry(kind, VALID, parts=[[Vertex(p["x"], p["y"]) for p in part] for part in parts])  # type: ignore[arg-type]


def parts_to_wkb(kind: str, parts: list[list[dict[str, float]]] | None) -> bytes | None:
    """WKB of real coordinates; rings are nested and oriented, damaged polygons give None."""
    g = _real_geometry(kind, parts)
    try:
        if kind == POLYGON and g.status == VALID:
            arrange_rings(g)
    except BlobError:
        return None
    return to_wkb(g, Grid())


def with_wkb(df: DataFrame, kind: str, parts_col: str = "gparts") -> DataFrame:
    """Adds `wkb` of the parts, in Arrow batches."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("wkb", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(parts_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parts_to_wkb(kind, p) for p in column], pa.binary())], names=[*names, "wkb"])

    return df.mapInArrow(run, schema)


def with_wkt(df: DataFrame, wkb_col: str = "wkb") -> DataFrame:
    """Adds `wkt` of a WKB column, in Arrow batches."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("wkt", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(wkb_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([wkb_to_wkt(w) for w in column], pa.string())], names=[*names, "wkt"])

    return df.mapInArrow(run, schema)
