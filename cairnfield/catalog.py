"""Datasets, groups, layers and cursors: the calls a user of feature layers makes."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cairnfield.errors import Code, EngineError
from cairnfield.operators import relations, spatial
from cairnfield.plans.query import FID, Query, build, checked, geometry_columns, metrics, validate
from cairnfield.sources import filegdb, metadata

MAX_URI_BYTES = 8192


@dataclass(frozen=True)
class Budget:
    """Bounds of read_all; more is an error, never a cut. 0: none."""

    features: int = 1_000_000
    total_bytes: int = 512 << 20
    feature_bytes: int = 64 << 20


def parse_uri(uri: str) -> str:
    """A path or an object-store URI of a geodatabase directory."""
    if not uri or len(uri.encode()) > MAX_URI_BYTES or "\x00" in uri:
        raise EngineError(Code.INVALID_REQUEST, "not a usable address")
    if m := re.match(r"(s3a?)://([^/]*)/?(.*)", uri):
        if not re.fullmatch(r"[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]", m[2]) or not m[3]:
            raise EngineError(Code.INVALID_REQUEST, "bucket or key is missing or malformed")
        if set("?@") & set(m[3]) or {"", ".", ".."} & set(m[3].rstrip("/").split("/")) or not m[3].rstrip("/").endswith(".gdb"):
            raise EngineError(Code.INVALID_REQUEST, "key is no geodatabase directory")
        return f"s3a://{m[2]}/{m[3].rstrip('/')}"
    return uri.removeprefix("file://").rstrip("/") or "/"


@dataclass(frozen=True)
class Route:
    """Where an address goes. There is one engine, and it reads geodatabase directories of mounted file systems; an object store's address is named as such and refused when it is opened."""

    uri: str
    source: str
    engine: str = "spark"
    fallback: bool = False


def route(uri: str) -> Route:
    parsed = parse_uri(uri)
    return Route(parsed, "object store" if parsed.startswith("s3a://") else "directory")


def canonical(path: str) -> str:
    return "/" + "/".join(p for p in path.replace("\\", "/").split("/") if p)


class Layer:
    """One layer: a DataFrame with `fid`, attributes and, for features, geometry columns."""

    def __init__(self, dataset: Dataset, name: str, df: DataFrame, kind: str | None):
        self.dataset, self.name, self.df = dataset, name, df
        self._source = dataset.source_of(name)
        self.kind = kind if kind or "gkind" in df.columns else spatial.POINT
        self.has_geometry = bool(geometry_columns(df))

    @property
    def schema(self):
        return self.df.select([c for c in self.df.columns if c not in geometry_columns(self.df)]).schema

    def query(self, query: Query) -> DataFrame:
        self.dataset.check_unchanged()
        return checked(build(self._scan(query), query, self.kind), query.max_features)

    def _scan(self, query: Query) -> DataFrame:
        """The layer with no more columns and rows than the query needs, where its source can leave them out."""
        where = validate(self.df, query)
        if self._source is None:
            return self.df
        options: dict[str, str] = {}
        if query.fields is not None:
            options["fields"] = ",".join(dict.fromkeys([*query.fields, *(where.references if where else ())]))
        if self.has_geometry and query.box is None and not query.with_geometry:
            options["geometry"] = "false"
        if query.box is not None:
            options["box"] = ",".join(map(repr, map(float, query.box)))
        if query.fid is not None:
            options |= {"first_fid": str(query.fid), "stop_fid": str(query.fid + 1)}
        elif query.from_fid is not None:
            options["first_fid"] = str(max(0, query.from_fid))
        return filegdb.read_layer(self.dataset.spark, *self._source, **options)

    def explain(self, query: Query) -> str:
        """The kind of access and the physical plan."""
        df = build(self._scan(query), query, self.kind)
        return f"path: {query.path}\n{df._jdf.queryExecution().toString()}"

    def capabilities(self) -> dict[str, bool]:
        fid = FID in self.df.columns
        return {"random_read": fid, "ordered": fid, "where": True, "box": self.has_geometry, "box_and_where": self.has_geometry, "write": False}

    def count(self, query: Query | None = None) -> int:
        return self.query(query or Query()).count()

    def extent(self) -> spatial.Box | None:
        if not self.has_geometry:
            return None
        row = relations.extent(self.df).first()
        return None if row is None or row["xmin"] is None else spatial.Box(*row)

    def metrics(self, query: Query) -> Row:
        return metrics(self.df, query, self.kind).first()

    def read(self, fid: int) -> Row | None:
        """The feature of the id, None if there is none."""
        if fid < 0:
            raise EngineError(Code.INVALID_REQUEST, "feature ids are not negative")
        return self.query(Query(fid=fid)).first()

    def cursor(self, query: Query | None = None, timeout: float | None = None) -> Cursor:
        return Cursor(self, query or Query(by_fid=True), timeout)

    def read_all(self, query: Query | None = None, budget: Budget | None = None, timeout: float | None = None) -> list[Row]:
        """All rows of the query, on the driver, within the budget."""
        budget = budget or Budget()
        rows, total = [], 0
        with self.cursor(query, timeout) as cursor:
            for row in cursor:
                size = sum(len(v) if isinstance(v, (bytes, bytearray, str)) else 8 for v in row)
                total += size
                if budget.feature_bytes and size > budget.feature_bytes:
                    raise EngineError(Code.MEMORY_LIMIT, "a feature is over its budget")
                if budget.total_bytes and total > budget.total_bytes:
                    raise EngineError(Code.MEMORY_LIMIT, "the result is over its budget")
                rows.append(row)
                if budget.features and len(rows) > budget.features:
                    raise EngineError(Code.RESULT_LIMIT, f"more than {budget.features} features")
        return rows


class Cursor:
    """Rows one after another, a partition at a time; can be moved to a feature id, cancelled, or stopped by a deadline."""

    def __init__(self, layer: Layer, query: Query, timeout: float | None = None):
        self._layer, self._query = layer, query
        self._rows: Iterator[Row] | None = None
        self._stopped: Code | None = None
        self._timer: threading.Timer | None = None
        if timeout is not None:
            self._timer = threading.Timer(timeout, self._stop, (Code.DEADLINE,))
            self._timer.daemon = True
            self._timer.start()

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_: object) -> None:
        if self._timer:
            self._timer.cancel()

    def _stop(self, code: Code) -> None:
        self._stopped = self._stopped or code

    def cancel(self) -> None:
        self._stop(Code.CANCELLED)

    def move_to(self, fid: int) -> None:
        """The next row is the first whose id is fid or more, before or after the rows read."""
        if fid < 0:
            raise EngineError(Code.INVALID_REQUEST, "feature ids are not negative")
        self._query = Query(**{**self._query.__dict__, "from_fid": fid, "by_fid": True, "offset": 0})
        self._rows = None

    def __iter__(self) -> Iterator[Row]:
        return self

    def __next__(self) -> Row:
        if self._stopped:
            raise EngineError(self._stopped, "no more rows are given")
        if self._rows is None:
            self._rows = self._layer.query(self._query).toLocalIterator()
        return next(self._rows)


@dataclass
class Group:
    """A node of the tree of groups."""

    path: str
    layers: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)


class Dataset:
    """A geodatabase directory, or a set of DataFrames under group paths such as `/roads/centre_lines`."""

    def __init__(self, spark: SparkSession, layers: dict[str, tuple[DataFrame, str | None]], database: filegdb.Geodatabase | None = None):
        self.spark, self._database = spark, database
        self._layers = {canonical(p): v for p, v in layers.items()}

    @classmethod
    def open(cls, spark: SparkSession, uri: str, system: bool = False) -> Dataset:
        at = route(uri)
        if at.source != "directory":
            raise EngineError(Code.UNSUPPORTED, f"{at.uri}: mount the object store to open a geodatabase in it")
        database = filegdb.Geodatabase(at.uri)
        layers: dict[str, tuple[DataFrame, str | None]] = {}
        for name in database.layer_names(system):
            layers["/" + name] = (filegdb.read_layer(spark, database.path, name), None)
        return cls(spark, layers, database)

    def check_unchanged(self) -> None:
        if self._database:
            self._database.check_unchanged()

    def source_of(self, path: str) -> tuple[str, str] | None:
        """Directory and table of a layer that is read from a geodatabase."""
        return (self._database.path, path.rsplit("/", 1)[1]) if self._database else None

    def layer_names(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1] for p in self._layers)

    def layer(self, name: str) -> Layer:
        """By canonical path or by name: exact, else in any ASCII case; several are an error."""
        if name.startswith("/"):
            found = [p for p in self._layers if p == canonical(name)]
        else:
            found = [p for p in self._layers if p.rsplit("/", 1)[1] == name] or [p for p in self._layers if p.rsplit("/", 1)[1].lower() == name.lower()]
        if len(found) != 1:
            raise EngineError(Code.AMBIGUOUS if found else Code.NOT_FOUND, f"layer {name}")
        df, kind = self._layers[found[0]]
        return Layer(self, found[0], df, kind)

    def group(self, path: str = "/") -> Group:
        at = canonical(path)
        prefix = at if at.endswith("/") else at + "/"
        below = [p for p in self._layers if p.startswith(prefix)]
        if not below and at != "/":
            raise EngineError(Code.NOT_FOUND, f"group {at}")
        rest = [p[len(prefix) :].split("/") for p in below]
        return Group(at, sorted(r[0] for r in rest if len(r) == 1), sorted({r[0] for r in rest if len(r) > 1}))

    def system_table(self, name: str) -> DataFrame | None:
        """A system table (`GDB_Items` and its like) with columns in lower case, None where there is none."""
        if self._database is None or not any(n.lower() == name.lower() for n in self._database.names):
            return None
        df = filegdb.read_layer(self.spark, self._database.path, name)
        return df.toDF(*(c.lower() for c in df.columns))

    def items(self) -> DataFrame:
        """Items with the names that the metadata functions use."""
        df = self.system_table("GDB_Items")
        if df is None:
            raise EngineError(Code.NOT_FOUND, "GDB_Items")
        renamed = {"physicalname": "physical_name"}
        return df.select(*(F.col(c).alias(renamed.get(c, c)) for c in df.columns))

    def metadata(self) -> dict[str, DataFrame]:
        """Domains, subtypes, field bindings, relationship classes and groups, all of one state of the files: a change meanwhile is an error."""
        self.check_unchanged()
        items = self.items()
        found = {
            "domains": metadata.domains(items),
            "subtypes": metadata.subtypes(items),
            "field_bindings": metadata.field_bindings(items),
            "relationship_classes": metadata.relationship_attributes(items),
            "groups": metadata.groups(items.where("path is not null")),
        }
        self.check_unchanged()
        return found

    def files(self) -> DataFrame:
        """table_id, ext, name, size of the directory's files."""
        entries = self._database.files if self._database else []
        return self.spark.createDataFrame([(e.table_id, e.ext, e.name, e.size) for e in entries], "table_id long, ext string, name string, size long")

    def audit(self) -> DataFrame | None:
        """Status, rows and digest of the system tables."""
        return relations.audit({n: self.system_table(n) for n in ("GDB_Items", "GDB_ItemRelationships", "GDB_ItemRelationshipTypes", "GDB_ItemTypes", "GDB_SpatialRefs")})

    def register_views(self) -> list[str]:
        """A temporary view of each layer, for SQL."""
        for path, (df, _) in self._layers.items():
            df.createOrReplaceTempView(path.rsplit("/", 1)[1])
        return self.layer_names()
