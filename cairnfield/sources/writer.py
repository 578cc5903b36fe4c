"""Writes small geodatabase directories: samples for queries and tests, held in memory a table at a time."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable

from cairnfield.operators.geometry import signed_bytes, unsigned_bytes
from cairnfield.sources.filegdb import BINARY, BLOCK_ROWS, DATETIME_OFFSET, GEOMETRY, NULLABLE, NUMBERS, OBJECTID, STRING, UUID_1, UUID_2, XML

ORIGIN, SCALE = -4000.0, 1000.0
# Numbers of the layers' geometry types and of the blobs'.
LAYER_TYPES = {"": 0, "point": 1, "multipoint": 2, "line": 3, "polygon": 4}
BLOB_TYPES = {"point": 1, "multipoint": 8, "line": 3, "polygon": 5}


def _name(text: str) -> bytes:
    data = text.encode("utf-16-le")
    return bytes([len(data) // 2]) + data


def _cell(value: float) -> int:
    return round((value - ORIGIN) * SCALE)


def blob(kind: str, parts: list[list[tuple[float, float]]]) -> bytes:
    """A geometry as a blob on the grid of this module; rings are closed."""
    points = [(_cell(x), _cell(y)) for part in parts for x, y in part]
    out = unsigned_bytes(BLOB_TYPES[kind])
    if kind == "point":
        return out + unsigned_bytes(points[0][0] + 1) + unsigned_bytes(points[0][1] + 1)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    out += unsigned_bytes(len(points))
    if kind != "multipoint":
        out += unsigned_bytes(len(parts))
    out += b"".join(map(unsigned_bytes, (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))))
    if kind != "multipoint":
        out += b"".join(unsigned_bytes(len(part)) for part in parts[:-1])
    x = y = 0
    for px, py in points:
        out += signed_bytes(px - x) + signed_bytes(py - y)
        x, y = px, py
    return out


class TableWriter:
    """One table: fields are (name, type number, nullable), the object id among them; rows are tuples of the others, None for a deleted id."""

    def __init__(self, fields: list[tuple[str, int, bool]], kind: str = ""):
        self._fields, self._kind = fields, kind

    def _descriptors(self) -> bytes:
        out = b""
        for name, number, nullable in self._fields:
            flag = bytes([NULLABLE if nullable else 0])
            out += _name(name) + _name(name) + bytes([number])
            if number in NUMBERS or number == DATETIME_OFFSET:
                out += struct.pack("B", 8) + flag + b"\x00"
            elif number == STRING:
                out += struct.pack("<I", 255) + flag + b"\x00"
            elif number in (OBJECTID, BINARY, UUID_1, UUID_2, XML):
                out += b"\x00" + flag
            elif number == GEOMETRY:
                wkt = "LOCAL_CS".encode("utf-16-le")
                out += b"\x00" + flag + struct.pack("<H", len(wkt)) + wkt + b"\x01" + struct.pack("<8d", ORIGIN, ORIGIN, SCALE, 1 / SCALE, 0, 0, 1000, 1000) + b"\x00" + struct.pack("<Id", 1, 100.0)
        return out

    def _row(self, values: tuple) -> bytes:
        others = [f for f in self._fields if f[1] != OBJECTID]
        absent = [value is None for (_, _, nullable), value in zip(others, values, strict=True) if nullable]
        out = bytearray((len(absent) + 7) // 8)
        for i, gone in enumerate(absent):
            out[i // 8] |= gone << i % 8
        for (_, number, _), value in zip(others, values, strict=True):
            if value is None:
                continue
            if number in NUMBERS:
                out += struct.pack("<" + NUMBERS[number], value)
            elif number == DATETIME_OFFSET:
                out += struct.pack("<dh", *value)
            elif number in (UUID_1, UUID_2):
                out += value
            else:
                data = value.encode() if isinstance(value, str) else value
                out += unsigned_bytes(len(data)) + data
        return bytes(out)

    def write(self, directory: str, table_id: int, rows: Iterable[tuple | None]) -> None:
        path = os.path.join(directory, f"a{table_id:08x}.gdbtable")
        section = struct.pack("<IIH", 4, LAYER_TYPES[self._kind], len(self._fields)) + self._descriptors()
        offsets = []
        with open(path, "wb") as out:
            out.write(struct.pack("<6I2Q", 3, 0, 0, 0, 0, 0, 0, 40) + struct.pack("<I", len(section)) + section)
            for values in rows:
                offsets.append(0 if values is None else out.tell())
                if values is not None:
                    data = self._row(values)
                    out.write(struct.pack("<I", len(data)) + data)
        blocks = -(-len(offsets) // BLOCK_ROWS)
        with open(path[: -len("table")] + "tablx", "wb") as out:
            out.write(struct.pack("<4I", 3, blocks, len(offsets), 5))
            out.write(b"".join(o.to_bytes(5, "little") for o in offsets + [0] * (blocks * BLOCK_ROWS - len(offsets))))
            out.write(struct.pack("<4I", 0, 0, blocks, 0))


def write_geodatabase(directory: str, tables: dict[str, tuple[TableWriter, Iterable[tuple | None]]]) -> None:
    """A directory with the tables, by name, and the catalog that names them."""
    os.makedirs(directory)
    TableWriter([("OBJECTID", OBJECTID, False), ("Name", STRING, False)]).write(directory, 1, [("GDB_SystemCatalog",), *((name,) for name in tables)])
    for k, (writer, rows) in enumerate(tables.values(), 2):
        writer.write(directory, k, rows)
