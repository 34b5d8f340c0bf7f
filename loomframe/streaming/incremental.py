"""Tables that grow: predicates and statistics by group over a stream, with the same expressions as over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions import statistics as S
from loomframe.plans.predicates import QueryString


def matching(stream: DataFrame, query: str) -> DataFrame:
    """Rows of a stream where a query string holds."""
    name, op, value = next(s for s in QueryString.splits(query) if s[0] in stream.columns)
    return stream.filter(QueryString.of(name, op, value).element(F.col(name), stream.schema[name].dataType))


def group_statistics(stream: DataFrame, by: str, feature: str, statistics: list[str], time: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Statistics of one pass by group, and by window of event time where `time` is given; rows later than `late` are let go."""
    aggs = [S.AGGREGATES[S.canonical(s)](F.col(feature), stream.schema[feature].dataType).alias(s.replace(" ", "_")) for s in statistics]
    keys = [F.col(by)]
    if time:
        stream = stream.withWatermark(time, late)
        keys = [F.window(time, window), *keys]
    return stream.groupBy(*keys).agg(*aggs)
