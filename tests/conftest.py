"""One Spark session for all tests, and a writer of small geodatabase directories."""

from __future__ import annotations

import os
import struct
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utf16(text: str) -> bytes:
    data = text.encode("utf-16-le")
    return bytes([len(data) // 2]) + data


class GdbWriter:
    """Bytes of one table: fields are (name, kind, nullable); rows are bytes or None for deleted ids."""

    def __init__(self, fields, layer_flags: int = 0, version: int = 3, width: int = 5):
        self.fields, self.flags, self.version, self.width = fields, layer_flags, version, width

    def descriptors(self) -> bytes:
        out = b""
        for name, kind, nullable in self.fields:
            out += utf16(name) + utf16("alias of " + name) + bytes([kind])
            flag = bytes([1 if nullable else 0])
            if kind in (0, 1, 2, 3, 5, 13, 14, 15, 16):
                out += b"\x04" + flag + b"\x00"
            elif kind == 4:
                out += struct.pack("<I", 50) + flag + b"\x00"
            elif kind in (6, 8, 10, 11, 12):
                out += b"\x00" + flag
            elif kind == 7:
                wkt = "GEOGCS[x]".encode("utf-16-le")
                out += b"\x00" + flag + struct.pack("<H", len(wkt)) + wkt + bytes([1]) + struct.pack("<3d", -400.0, -400.0, 1000.0) + struct.pack("<d", 0.001) + struct.pack("<4d", 0, 0, 10, 10) + b"\x00" + struct.pack("<Id", 1, 2.0)
        return out

    def row(self, values) -> bytes:
        """values by field in order; the object id is left out."""
        from cairnfield.operators.geometry import unsigned_bytes

        bits, body, at = [], b"", 0
        for name, kind, nullable in self.fields:
            if kind == 6:
                continue
            value = values[at]
            at += 1
            if nullable:
                bits.append(value is None)
            if value is None:
                continue
            if kind in (0, 1, 2, 3, 5, 13, 14, 15):
                body += struct.pack({0: "<h", 1: "<i", 2: "<f", 3: "<d", 5: "<d", 13: "<q", 14: "<d", 15: "<d"}[kind], value)
            elif kind == 16:
                body += struct.pack("<dh", *value)
            elif kind in (10, 11):
                body += value
            else:
                data = value.encode() if isinstance(value, str) else value
                body += unsigned_bytes(len(data)) + data
        bitmap = bytearray((len(bits) + 7) // 8)
        for i, b in enumerate(bits):
            bitmap[i // 8] |= b << i % 8
        return bytes(bitmap) + body

    def write(self, directory, table_id: int, rows) -> None:
        head = struct.pack("<IIIIII", self.version, len(rows), 0, 0, 0, 0) + struct.pack("<QQ", 0, 40)
        section = struct.pack("<II", 4, self.flags) + struct.pack("<H", len(self.fields)) + self.descriptors()
        body = head + struct.pack("<I", len(section)) + section
        offsets, data = [], b""
        for row in rows:
            if row is None:
                offsets.append(0)
                continue
            offsets.append(len(body) + len(data))
            data += struct.pack("<I", len(row)) + row
        base = os.path.join(directory, f"a{table_id:08x}.gdbtable")
        Path(base).write_bytes(body + data)
        padded = offsets + [0] * (-len(offsets) % 1024)
        index = struct.pack("<IIII", 3, len(padded) // 1024, len(offsets), self.width)
        index += b"".join(o.to_bytes(self.width, "little") for o in padded) + struct.pack("<IIII", 0, 0, len(padded) // 1024, 0)
        Path(base[:-5] + "tablx").write_bytes(index)


@pytest.fixture
def gdb_dir(tmp_path):
    """Two layers: `places` (points, one deleted id, nulls) and `notes` (no geometry)."""
    from cairnfield.operators.geometry import unsigned_bytes

    directory = tmp_path / "small.gdb"
    directory.mkdir()
    catalog = GdbWriter([("OBJECTID", 6, False), ("Name", 4, False)])
    catalog.write(directory, 1, [catalog.row([n]) for n in ("GDB_SystemCatalog", "places", "notes", "GDB_Items")])
    items = GdbWriter([("OBJECTID", 6, False), ("Name", 4, True), ("PhysicalName", 4, True), ("Path", 4, True), ("Definition", 12, True)])
    domain = '<GPRangeDomain2 xsi:type="typens:GPRangeDomain2"><DomainName>Level</DomainName><MinValue>1</MinValue></GPRangeDomain2>'
    items.write(directory, 4, [items.row(["places", "PLACES", "/g/places", "<DatasetType>x</DatasetType>"]), items.row(["Level", "LEVEL", None, domain])])

    def point(x: float, y: float) -> bytes:
        return unsigned_bytes(1) + unsigned_bytes(round((x + 400) * 1000) + 1) + unsigned_bytes(round((y + 400) * 1000) + 1)

    places = GdbWriter([("OBJECTID", 6, False), ("value", 1, True), ("name", 4, True), ("category", 4, True), ("SHAPE", 7, True)])
    rows = [(5, "alpha", "A", point(1, 1)), (10, "beta", "A", point(2, 2)), (10, "beta", "B", point(20, 20)), (15, "gamma", "B", point(3, 3)), (-2, "成都", "A", point(4, 4)), (None, None, None, None)]
    data = [places.row(r) for r in rows]
    places.write(directory, 2, [*data[:5], None, data[5]])
    notes = GdbWriter([("OBJECTID", 6, False), ("s", 0, True), ("b", 13, False), ("f", 2, False), ("d", 3, True), ("u", 10, False), ("raw", 8, True), ("t", 5, False), ("o", 16, False), ("x", 12, True)], width=4)
    notes.write(directory, 3, [notes.row([-7, 1 << 40, 0.5, 2.25, bytes(range(16)), b"\x00\x01", 36526.5, (36526.25, -90), "<a/>"]), notes.row([None, -1, 1.0, None, bytes(16), None, 0.0, (0.0, 0), None])])
    return str(directory)
