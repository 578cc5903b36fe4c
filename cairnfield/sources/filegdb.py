"""Reader of geodatabase directories (`a00000001.gdbtable` and its companions) and its Spark data source.

A table file holds field descriptors and length-prefixed rows; its offset file gives the place of each
row by feature id, zero where there is none. The driver reads the descriptors; tasks read ranges of
feature ids, so a table is scanned by as many tasks as it has rows for.

A row that cannot be decoded is an error; feature ids are zero-based and `objectid` is one more.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from cairnfield.errors import Code, EngineError
from cairnfield.operators.geometry import GEOM, NULL, VALID, BlobError, Geometry, Grid, Reader, decode_blob, peek_envelope, to_wkb

# Numbers of the field types.
INT16, INT32, FLOAT32, FLOAT64, STRING, DATETIME, OBJECTID, GEOMETRY, BINARY, RASTER, UUID_1, UUID_2, XML, INT64, DATE, TIME, DATETIME_OFFSET = range(17)
NUMBERS = {INT16: "h", INT32: "i", INT64: "q", FLOAT32: "f", FLOAT64: "d", DATETIME: "d", DATE: "d", TIME: "d"}
NULLABLE, HAS_DEFAULT = 1, 4
BLOCK_ROWS = 1024
ROWS_PER_TASK = 100_000
BATCH_ROWS = 4096
_FILE = re.compile(r"a([0-9a-f]{8})\.(\w+)", re.IGNORECASE)


@dataclass
class Field:
    name: str
    alias: str
    kind: int
    width: int = 0
    flag: int = 0
    default: bytes | None = None
    wkt: str = ""
    grid: Grid = field(default_factory=Grid)
    extent: tuple[float, float, float, float] | None = None
    cell_sizes: tuple[float, ...] = ()

    @property
    def nullable(self) -> bool:
        return bool(self.flag & NULLABLE)


def _utf16(reader: Reader, units: int) -> str:
    return reader.take(2 * units).decode("utf-16-le", "replace").split("\x00")[0]


def _read_field(reader: Reader, layer_z: bool, layer_m: bool) -> Field:
    out = Field(_utf16(reader, reader.byte()), _utf16(reader, reader.byte()), reader.byte())
    if out.kind in NUMBERS or out.kind == DATETIME_OFFSET:
        out.width, out.flag = reader.byte(), reader.byte()
        size = reader.byte()
        if size and out.flag & HAS_DEFAULT:
            out.default = reader.take(size)
    elif out.kind == STRING:
        out.width, out.flag = reader.unpack("I"), reader.byte()
        size = reader.unsigned()
        if size and out.flag & HAS_DEFAULT:
            out.default = reader.take(size)
    elif out.kind in (OBJECTID, BINARY, UUID_1, UUID_2, XML):
        out.width, out.flag = reader.byte(), reader.byte()
    elif out.kind == RASTER:
        out.flag = reader.byte()
        _utf16(reader, reader.byte())
        _utf16(reader, reader.unpack("H") // 2)
        reader.take(2)
    elif out.kind == GEOMETRY:
        reader.byte()
        out.flag = reader.byte()
        out.wkt = _utf16(reader, reader.unpack("H") // 2)
        flags = reader.byte()
        has_m, has_z = bool(flags & 2), bool(flags & 4)
        real = lambda: reader.unpack("d")
        x, y, scale = real(), real(), real()
        m, m_scale = (real(), real()) if has_m else (0.0, 1.0)
        z, z_scale = (real(), real()) if has_z else (0.0, 1.0)
        for _ in range(1 + has_m + has_z):  # tolerances
            real()
        out.extent = (real(), real(), real(), real())
        for _ in range(2 * (layer_z + layer_m)):
            real()
        reader.byte()
        out.cell_sizes = tuple(real() for _ in range(reader.unpack("I")))
        out.grid = Grid(x, y, scale, z, z_scale, m, m_scale, layer_z, layer_m)
    else:
        raise EngineError(Code.CORRUPT, f"field {out.name} has the unknown type {out.kind}")
    return out


class TableFile:
    """Header, descriptors and rows of one table."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path, "rb") as source:
                head = source.read(40)
                version = struct.unpack_from("<I", head)[0]
                if version not in (3, 4):
                    raise EngineError(Code.CORRUPT, f"unknown table version {version}")
                at = struct.unpack_from("<Q", head, 32)[0]
                source.seek(at)
                size = struct.unpack("<I", source.read(4))[0]
                body = source.read(size)
            reader = Reader(body)
            reader.take(4)
            self.layer_flags = reader.unpack("I")
            top = self.layer_flags >> 24
            self.fields = [_read_field(reader, bool(top & 0x80), bool(top & 0x40)) for _ in range(reader.unpack("H"))]
        except (OSError, struct.error, BlobError) as error:
            raise EngineError(Code.CORRUPT if not isinstance(error, OSError) else Code.READ_FAILED, f"{path}: {error}") from error
        self._bits = {f.name: i for i, f in enumerate(f for f in self.fields if f.nullable)}

    @property
    def geometry(self) -> Field | None:
        return next((f for f in self.fields if f.kind == GEOMETRY), None)

    def offsets(self, start: int = 0, stop: int | None = None) -> list[int]:
        """Places of the rows of feature ids from start to stop, 0 where there is none; only that part of the file is read."""
        path = self.path[: -len("table")] + "tablx"
        try:
            with open(path, "rb") as source:
                blocks, rows, width, kept = self._index_head(source)
                n = rows or (len(kept) if kept is not None else blocks) * BLOCK_ROWS
                stop = n if stop is None else min(stop, n)
                out: list[int] = []
                while start + len(out) < stop:
                    at = start + len(out)
                    block, inside = divmod(at, BLOCK_ROWS)
                    take = min(stop - at, BLOCK_ROWS - inside)
                    place = block if kept is None else kept[block]
                    if place < 0:
                        out += [0] * take
                        continue
                    source.seek(16 + (place * BLOCK_ROWS + inside) * width)
                    data = source.read(take * width)
                    if len(data) < take * width:
                        raise EngineError(Code.CORRUPT, f"{path}: truncated")
                    out += [int.from_bytes(data[k : k + width], "little") for k in range(0, len(data), width)]
                return out
        except (OSError, struct.error) as error:
            raise EngineError(Code.READ_FAILED, f"{path}: {error}") from error

    def __len__(self) -> int:
        """Feature ids, deleted ones included."""
        with open(self.path[: -len("table")] + "tablx", "rb") as source:
            blocks, rows, _, kept = self._index_head(source)
        return rows or (len(kept) if kept is not None else blocks) * BLOCK_ROWS

    @staticmethod
    def _index_head(source) -> tuple[int, int, int, list[int] | None]:
        """Blocks in the file, rows (0: not said), bytes of an offset, and for sparse files the place of each block, -1 if left out."""
        head = source.read(16)
        version, blocks, rows, width = struct.unpack("<IIII", head)
        if version not in (3, 4) or width not in (4, 5, 6):
            raise EngineError(Code.CORRUPT, "offset file of unknown version or width")
        if version == 4:  # 64-bit number of blocks, no number of rows here
            return struct.unpack_from("<Q", head, 4)[0], 0, width, None
        source.seek(16 + blocks * BLOCK_ROWS * width)
        tail = source.read(16)
        words, bits = struct.unpack_from("<II", tail) if len(tail) == 16 else (0, 0)
        if not words:
            return blocks, rows, width, None
        bitmap, kept, place = source.read((bits + 7) // 8), [], 0
        for b in range(bits):
            present = b // 8 < len(bitmap) and bitmap[b // 8] >> b % 8 & 1
            kept.append(place if present else -1)
            place += bool(present)
        return blocks, rows, width, kept

    def row_bytes(self, source, offset: int, most: int = 1 << 30) -> bytes:
        source.seek(offset)
        size = struct.unpack("<I", source.read(4))[0]
        if size > most:
            raise EngineError(Code.MEMORY_LIMIT, f"row of {size} bytes")
        data = source.read(size)
        if len(data) < size:
            raise EngineError(Code.CORRUPT, "truncated row")
        return data

    def decode(self, fid: int, data: bytes, wanted: set[str] | None = None) -> dict[str, object]:
        """Values by field name; fields that are not wanted are passed over."""
        reader = Reader(data)
        out: dict[str, object] = {}
        try:
            bitmap = reader.take((len(self._bits) + 7) // 8) if data else b""
            for f in self.fields:
                if f.kind == OBJECTID:
                    out[f.name] = fid + 1
                    continue
                bit = self._bits.get(f.name)
                if not data or bit is not None and bitmap[bit // 8] >> bit % 8 & 1:
                    out[f.name] = None
                    continue
                value = self._value(f, reader, wanted is None or f.name in wanted)
                out[f.name] = value
        except BlobError as error:
            raise EngineError(Code.CORRUPT, f"{self.path}: feature {fid}: {error}") from error
        if any(data[reader.at :]):
            raise EngineError(Code.CORRUPT, f"{self.path}: feature {fid}: bytes after the last field")
        return out

    def _value(self, f: Field, reader: Reader, wanted: bool) -> object:
        if f.kind in NUMBERS:
            return reader.unpack(NUMBERS[f.kind])
        if f.kind == DATETIME_OFFSET:
            return reader.unpack("d"), reader.unpack("h")
        if f.kind in (UUID_1, UUID_2):
            raw = reader.take(16)
            return "-".join(p.hex() for p in (raw[3::-1], raw[5:3:-1], raw[7:5:-1], raw[8:10], raw[10:]))
        data = reader.take(reader.unsigned())
        if not wanted or f.kind == RASTER:
            return None
        return data.decode("utf-8", "replace") if f.kind in (STRING, XML) else data

    def rows(self, start: int = 0, stop: int | None = None, wanted: set[str] | None = None) -> Iterator[tuple[int, dict[str, object]]]:
        """(feature id, values) in feature-id order, deleted ids left out."""
        for fid, data in self.raw_rows(start, stop):
            yield fid, self.decode(fid, data, wanted)

    def raw_rows(self, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as source:
            for fid, place in enumerate(self.offsets(start, stop), start):
                if place:
                    yield fid, self.row_bytes(source, place)


@dataclass(frozen=True)
class FileEntry:
    table_id: int
    ext: str
    name: str
    size: int
    modified_ns: int


def list_files(path: str) -> list[FileEntry]:
    """The directory's table files by number and name."""
    try:
        names = os.listdir(path)
    except OSError as error:
        raise EngineError(Code.NOT_FOUND, str(error)) from error
    out = []
    for name in names:
        if m := _FILE.fullmatch(name):
            stat = os.stat(os.path.join(path, name))
            out.append(FileEntry(int(m[1], 16), m[2].lower(), name, stat.st_size, stat.st_mtime_ns))
    return sorted(out, key=lambda e: (e.table_id, e.name))


class Geodatabase:
    """A directory; table 1 names the others."""

    def __init__(self, path: str):
        self.path = path
        self.files = list_files(path)
        self.snapshot = tuple((e.name, e.size, e.modified_ns) for e in self.files)
        if not any(e.table_id == 1 and e.ext == "gdbtable" for e in self.files):
            raise EngineError(Code.NOT_FOUND, f"{path} has no system catalog")
        names = {}
        for fid, row in self.table(1).rows():
            name = row.get("Name") or row.get("name")
            if name:
                names[str(name)] = fid + 1
        self.names = dict(sorted(names.items()))

    def table(self, table_id: int) -> TableFile:
        return TableFile(os.path.join(self.path, f"a{table_id:08x}.gdbtable"))

    def resolve(self, name: str) -> int:
        """Number of the table of the name: exact, else in any ASCII case, which must then be one."""
        if name in self.names:
            return self.names[name]
        near = [n for n in self.names if n.lower() == name.lower()]
        if len(near) != 1:
            raise EngineError(Code.AMBIGUOUS if near else Code.NOT_FOUND, f"table {name}")
        return self.names[near[0]]

    def open(self, name: str) -> TableFile:
        return self.table(self.resolve(name))

    def layer_names(self, system: bool = False) -> list[str]:
        return [n for n in self.names if system or not n.lower().startswith("gdb_")]

    def check_unchanged(self) -> None:
        """Any file that came, went or changed since the directory was opened is an error."""
        if tuple((e.name, e.size, e.modified_ns) for e in list_files(self.path)) != self.snapshot:
            raise EngineError(Code.SOURCE_CHANGED, self.path)


_SPARK_TYPES: dict[int, T.DataType] = {
    INT16: T.IntegerType(), INT32: T.IntegerType(), INT64: T.LongType(), FLOAT32: T.DoubleType(), FLOAT64: T.DoubleType(), STRING: T.StringType(), XML: T.StringType(), BINARY: T.BinaryType(), UUID_1: T.StringType(), UUID_2: T.StringType(),
    DATETIME: T.DoubleType(), DATE: T.DoubleType(), TIME: T.DoubleType(), DATETIME_OFFSET: T.StructType([T.StructField("ole", T.DoubleType()), T.StructField("offset_minutes", T.IntegerType())]),
}
GBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
GPARTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def schema_of(table: TableFile, fields: list[str] | None = None, raw: bool = False, geometry: bool = True) -> T.StructType:
    """fid, objectid, the attributes (dates as OLE numbers), the geometry if there is one, and with raw the bytes of the row."""
    out = [T.StructField("fid", T.LongType(), False), T.StructField("objectid", T.LongType(), False)]
    for f in table.fields:
        if f.kind in _SPARK_TYPES and (fields is None or f.name in fields):
            out.append(T.StructField(f.name, _SPARK_TYPES[f.kind], f.nullable, {"alias": f.alias, "width": f.width, "physical_type": f.kind}))
    if table.geometry and geometry:
        out += [T.StructField("geom", GEOM), T.StructField("gbox", GBOX), T.StructField("gparts", GPARTS), T.StructField("gkind", T.StringType())]
    return T.StructType([*out, T.StructField("raw_row", T.BinaryType())] if raw else out)


def geometry_row(blob: object, grid: Grid, is_null: bool, on_invalid: str) -> tuple:
    """(geom, gbox, gparts, kind) of a blob."""
    if is_null:
        return (None, None, None, None, NULL, "", False), None, None, None
    g: Geometry = decode_blob(blob, grid)  # type: ignore[arg-type]
    if g.status not in (VALID, "empty") and on_invalid == "fail":
        raise EngineError(Code.INVALID_GEOMETRY, g.diagnostic)
    wkb = to_wkb(g, grid)
    code = struct.unpack_from("<I", wkb, 1)[0] if wkb else None
    parts = [[dict(zip("xy", grid.real(v), strict=True)) for v in part] for part in g.parts] or None
    # what cannot be decoded still meets a box that holds its whole envelope
    box = peek_envelope(blob, grid) if g.status not in (VALID, "empty") else None  # type: ignore[arg-type]
    if parts:
        xs, ys = [p["x"] for part in parts for p in part], [p["y"] for part in parts for p in part]
        box = (min(xs), min(ys), max(xs), max(ys))
    return (wkb, code, g.has_z, g.has_m, g.status, g.diagnostic, g.was_curve), box, [[tuple(p.values()) for p in part] for part in parts] if parts else None, g.kind


@dataclass
class _Range(InputPartition):
    start: int
    stop: int

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    """Reads ranges of feature ids; with a box it passes over rows by the envelope in the blob, before the geometry is decoded."""

    def __init__(self, table: TableFile, schema: T.StructType, options: dict[str, str]):
        self._table, self._schema = table, schema  # the descriptors go to the tasks
        self._rows, self._on_invalid = int(options.get("rows_per_task", str(ROWS_PER_TASK))), options.get("on_invalid_geometry", "fail")
        self._first, self._stop = (int(options.get(k, d)) for k, d in (("first_fid", "0"), ("stop_fid", str(1 << 62))))
        self._box = tuple(map(float, options["box"].split(","))) if "box" in options else None

    def partitions(self) -> list[InputPartition]:
        stop = min(len(self._table), self._stop)
        return [_Range(at, min(stop, at + self._rows)) for at in range(self._first, stop, self._rows)] or [_Range(0, 0)]

    def _passed_over(self, blob: object, grid: Grid) -> bool:
        own, box = peek_envelope(blob, grid) if blob else None, self._box  # type: ignore[arg-type]
        return own is None or own[0] > box[2] or own[2] < box[0] or own[1] > box[3] or own[3] < box[1]  # type: ignore[index]

    def _rows_of(self, partition: InputPartition) -> Iterator[tuple]:
        table, names, shape = self._table, self._schema.names, self._table.geometry
        wanted = set(names) | ({shape.name} if shape and "geom" in names else set())
        for fid, data in table.raw_rows(partition.start, partition.stop):  # type: ignore[attr-defined]
            row = table.decode(fid, data, wanted)
            values: dict[str, object] = {**row, "fid": fid, "objectid": fid + 1, "raw_row": data}
            if shape and "geom" in names:
                if self._box and self._passed_over(row[shape.name], shape.grid):
                    continue
                values["geom"], values["gbox"], values["gparts"], values["gkind"] = geometry_row(row[shape.name], shape.grid, row[shape.name] is None, self._on_invalid)
            yield tuple(values[n] for n in names)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema, rows = to_arrow_schema(self._schema), self._rows_of(partition)
        while held := list(itertools.islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class GeodatabaseSource(DataSource):
    """Options: path, layer; fields (comma-separated) for fewer columns, geometry (false leaves it out), raw (true adds each row's bytes),
    first_fid and stop_fid, box (xmin,ymin,xmax,ymax: rows whose envelope does not meet it may be left out), rows_per_task, on_invalid_geometry (fail or keep_status).

    A query's columns, ids and box are options, set anew for each query, as Spark keeps the state of a reader that took its conditions.
    """

    @classmethod
    def name(cls) -> str:
        return "geodatabase"

    def _table(self) -> TableFile:
        return Geodatabase(self.options["path"]).open(self.options["layer"])

    def schema(self) -> T.StructType:
        fields = self.options.get("fields")
        return schema_of(self._table(), None if fields is None else fields.split(","), self.options.get("raw", "false") == "true", self.options.get("geometry", "true") == "true")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._table(), schema, dict(self.options))


def read_layer(spark: SparkSession, path: str, layer: str, **options: str):
    """A layer of a geodatabase directory as a DataFrame."""
    spark.dataSource.register(GeodatabaseSource)
    return spark.read.format("geodatabase").options(path=path, layer=layer, **options).load()
