"""Failures as rows: a status that goes with documents, tracks and the results of grouped maps, so that one bad trial costs only itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

STATUS = T.StructType([T.StructField(n, T.StringType()) for n in ("stage", "kind", "message")])
STATUS_ARROW = pa.struct([(n, pa.string()) for n in ("stage", "kind", "message")])
#: What a table of failures has.
FAILURES = ("trial_id", "stage", "kind", "message", "item")


def status(stage: str, kind: str, message: Column | str) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def described(stage: str, error: Exception) -> dict:
    return {"stage": stage, "kind": type(error).__name__, "message": str(error)[:500]}


def with_status(df: DataFrame) -> DataFrame:
    """df with a status that nothing has failed yet; a df that has one keeps it."""
    return df if "status" in df.columns else df.withColumn("status", F.lit(None).cast(STATUS))


def guarded(run: Callable[[pa.Table], pa.Table], schema: T.StructType, stage: str, keys: list[str]) -> tuple[Callable[[pa.Table], pa.Table], T.StructType]:
    """A grouped map and its schema with a status: a group for which ``run`` raises gives one row of its keys and what was raised."""
    own = T.StructType([*schema.fields, T.StructField("status", STATUS)])
    arrow = to_arrow_schema(own)

    def safe(table: pa.Table) -> pa.Table:
        try:
            out = run(table)
            return out.append_column("status", pa.nulls(out.num_rows, STATUS_ARROW)).select(arrow.names).cast(arrow)
        except Exception as error:  # whatever it is, it's the group's
            row = {k: table.column(k)[0].as_py() for k in keys} | {"status": described(stage, error)}
            return pa.Table.from_pylist([row], schema=arrow)

    return safe, own


def good(df: DataFrame) -> DataFrame:
    """The rows that nothing failed for, without the status."""
    return df.filter("status IS NULL").drop("status") if "status" in df.columns else df


def failures(df: DataFrame, item: str | None = None) -> DataFrame:
    """trial_id, stage, kind, message, item of what failed, each once; ``item`` is a column that says in which part."""
    rows = df.filter("status IS NOT NULL").select(F.col("trial_id").cast("string").alias("trial_id"), "status.*", (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias("item"))
    return rows.distinct()


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)
