"""One query over one layer: filters, order, paging and budgets, declared and then built as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.errors import Code, EngineError
from cairnfield.operators import spatial
from cairnfield.plans.where import BoundWhere

FID = "fid"
#: Columns that carry the geometry; a projection of attributes never drops them.
GEOMETRY = ("geom", "gbox", "gparts", "gkind")


@dataclass(frozen=True)
class Query:
    """fields: None for all; limit: 0 for all; max_features: 0 for no budget, else more rows are an error, not a cut."""

    fields: tuple[str, ...] | None = None
    where: str | None = None
    box: tuple[float, float, float, float] | None = None
    fid: int | None = None
    from_fid: int | None = None
    by_fid: bool = False
    offset: int = 0
    limit: int = 0
    max_features: int = 0
    with_geometry: bool = True

    @property
    def path(self) -> str:
        """What kind of access the query asks for."""
        if self.fid is not None:
            return "read_fid"
        return {(False, False): "sequential", (True, False): "where", (False, True): "spatial_bbox", (True, True): "spatial_where"}[self.where is not None, self.box is not None]


def geometry_columns(df: DataFrame) -> list[str]:
    return [c for c in GEOMETRY if c in df.columns]


def validate(df: DataFrame, query: Query) -> BoundWhere | None:
    """Everything that can be refused before Spark is asked."""
    if query.offset < 0 or query.limit < 0 or query.max_features < 0:
        raise EngineError(Code.INVALID_REQUEST, "offset, limit and budgets cannot be negative")
    for name in query.fields or ():
        if name not in df.columns or name in GEOMETRY:
            raise EngineError(Code.INVALID_REQUEST, f"unknown field {name}")
    if (query.fid is not None or query.from_fid is not None or query.by_fid) and FID not in df.columns:
        raise EngineError(Code.UNSUPPORTED, "the layer has no feature ids")
    if query.fid is not None and query.fid < 0:
        raise EngineError(Code.INVALID_REQUEST, "feature ids are not negative")
    if query.box is not None:
        spatial.Box(*query.box)
        if "gbox" not in df.columns:
            raise EngineError(Code.UNSUPPORTED, "the layer has no geometry")
    if query.where is None:
        return None
    return BoundWhere(query.where, df.select([c for c in df.columns if c not in GEOMETRY]).schema)


def box_condition(df: DataFrame, sides: tuple[float, float, float, float], kind: str | None) -> Column:
    """kind: None where every row says its own (`gkind`)."""
    box = spatial.Box(*sides)
    parts = F.col("gparts") if "gparts" in df.columns else None
    if kind is None:
        return spatial.meets_by_kind(F.col("gkind"), box, F.col("gbox"), parts) if "gkind" in df.columns and parts is not None else spatial.meets(spatial.POINT, box, F.col("gbox"), parts)
    return spatial.meets(kind, box, F.col("gbox"), parts)


def condition(df: DataFrame, query: Query, kind: str | None = spatial.POINT) -> Column | None:
    """All filters of the query as one Column; the box first, as its range conditions are what the scan can use."""
    where = validate(df, query)
    parts: list[Column] = []
    if query.fid is not None:
        parts.append(F.col(FID) == query.fid)
    if query.from_fid is not None:
        parts.append(F.col(FID) >= query.from_fid)
    if query.box is not None:
        parts.append(box_condition(df, query.box, kind))
    if where is not None:
        parts.append(where.column())
    out = None
    for part in parts:
        out = part if out is None else out & part
    return out


def build(df: DataFrame, query: Query, kind: str | None = spatial.POINT) -> DataFrame:
    """Filter, project, order, page. The budget is checked when rows are read (`checked`)."""
    wanted = condition(df, query, kind)
    out = df if wanted is None else df.where(wanted)
    if query.fields is not None or not query.with_geometry:
        names = list(query.fields) if query.fields is not None else [c for c in df.columns if c not in GEOMETRY]
        names = [FID, *names] if FID in df.columns and FID not in names else names
        out = out.select(*names, *(geometry_columns(df) if query.with_geometry else []))
    if query.by_fid:
        out = out.orderBy(FID)
    if query.offset:
        out = out.offset(query.offset)
    if query.limit:
        out = out.limit(query.limit)
    return out


def checked(df: DataFrame, max_features: int) -> DataFrame:
    """df, unless it has more than max_features rows; then an error and no rows."""
    if max_features and len(df.select(F.lit(1)).limit(max_features + 1).take(max_features + 1)) > max_features:
        raise EngineError(Code.RESULT_LIMIT, f"more than {max_features} features")
    return df


def metrics(df: DataFrame, query: Query, kind: str | None = spatial.POINT) -> DataFrame:
    """One row: candidates (envelope meets the box), rejected, contained, tested exactly, matched, and rows without a usable geometry."""
    validate(df, query)
    if query.box is None:
        raise EngineError(Code.INVALID_REQUEST, "metrics need a box")
    box, gbox = spatial.Box(*query.box), F.col("gbox")
    meets, inside = spatial.envelope_meets(gbox, box), spatial.envelope_inside(gbox, box)
    return df.select(
        F.count_if(meets).alias("candidates"),
        F.count_if(~meets).alias("rejected"),
        F.count_if(inside).alias("contained"),
        F.count_if(meets & ~inside).alias("tested"),
        F.count_if(box_condition(df, query.box, kind)).alias("matched"),
        F.count_if(gbox.isNull()).alias("invalid"),
    )
