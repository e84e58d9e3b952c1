"""Rows in one order over all partitions, packed into runs that know their place: what a global sort is for, without a single task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import in_batches, stored


def tie() -> Column:
    """Tells rows apart that are equal in all columns, so that a range of equal rows can be dealt to several tasks."""
    return F.xxhash64(F.monotonically_increasing_id())


def pack_runs(rows: DataFrame, order: list, payload: str, run: int = 8192) -> DataFrame:
    """Store rows (grp string, payload struct, and what ``order`` needs) as runs of at most ``run`` rows of one group.

    Rows are in the order of grp, then ``order``. A run is a row: part, run, grp, n, rows (array of the payload, of
    that type). Runs of a group ascend by part and run.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order).select("grp", "payload")

    def pack(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column(0).dictionary_encode()
            code = grp.indices.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
            cuts = np.unique(np.concatenate([edges, *(np.arange(a, b, run) for a, b in zip(edges[:-1], edges[1:], strict=True))]))
            n = np.diff(cuts)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(1))
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int64)), pa.array(number + np.arange(len(n))), batch.column(0).take(pa.array(cuts[:-1])), pa.array(n), lists], names=["part", "run", "grp", "n", "rows"])
            number += len(n)

    return stored(ranged.transform(in_batches, pack, f"part long, run long, grp string, n long, rows array<{payload}>"), "runs", 16 << 20)


def places(runs: DataFrame) -> DataFrame:
    """For each run: part, run, grp, first (rows of its group before it), size (rows of its group), number (runs of its group before it).

    Counts are summed by part first and runs counted within their part, so that no window holds all runs of a group.
    """
    counts = runs.select("part", "run", "grp", "n")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    by_part = counts.groupBy("grp", "part").agg(F.sum("n").alias("rows"), F.count("*").alias("runs"))
    whole, within = Window.partitionBy("grp").orderBy("part"), Window.partitionBy("grp", "part").orderBy("run")
    parts = by_part.select("grp", "part", zero("rows", whole).alias("rows_before"), zero("runs", whole).alias("runs_before"), F.sum("rows").over(Window.partitionBy("grp")).alias("size"))
    own = counts.select("grp", "part", "run", zero("n", within).alias("first"), zero(F.lit(1), within).alias("number"))
    return own.join(parts, ["grp", "part"]).select("part", "run", "grp", (F.col("first") + F.col("rows_before")).alias("first"), "size", (F.col("number") + F.col("runs_before")).alias("number"))
