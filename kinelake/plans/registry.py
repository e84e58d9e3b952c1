"""The queries of the motion engine by name, over series carved from generic tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.plans import check_queries, feature_queries, kernel_queries, label_queries, series_queries, walk_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (series_queries, walk_queries, kernel_queries, label_queries, check_queries, feature_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadence and mean curve per trial and side: events to cycles, cycles to curves of 101 points, curves to their mean and deviation."""
    return series_queries.cycle_curve_summary(spark, sf_dir)
