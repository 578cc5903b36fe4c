"""A query's filters on a stream of features.

Order, paging and budgets need a whole result, so a stream takes filters and projection alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairnfield.errors import Code, EngineError
from cairnfield.operators import spatial
from cairnfield.plans.query import Query, build


def filtered_stream(stream: DataFrame, query: Query, kind: str = spatial.POINT) -> DataFrame:
    if query.by_fid or query.offset or query.limit or query.max_features:
        raise EngineError(Code.UNSUPPORTED, "a stream has no order, pages or budget")
    return build(stream, query, kind)
