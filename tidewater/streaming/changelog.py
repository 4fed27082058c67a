"""Change feeds with signed multiplicities, and aggregate views maintained from them.

A change feed has the columns of its table and `_freq`: +1 for a row that
came, -1 for one that went. Counts, sums and averages are sums of what came
minus what went, so a view needs the feed only, not the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.relational import FREQ, consolidate


def grouped_view(changes: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """count(*) as `n`, and count and sum of each of `sums`, by `keys`, as of all changes so far; groups without rows are gone.

    A sum of no value that is not NULL is NULL. Batch or streaming (complete mode).
    """
    w = F.col(FREQ)
    made: list[Column] = [F.sum(w).alias("n")]
    for c in sums:
        there = F.col(c).isNotNull().cast("long") * w
        made += [F.sum(there).alias(f"count_{c}"), F.sum(F.coalesce(F.col(c) * w, F.lit(0))).alias(f"_sum_{c}")]
    out = changes.groupBy(*keys).agg(*made).where("n <> 0")
    return out.select(*keys, "n", *[x for c in sums for x in (F.col(f"count_{c}"), F.when(F.col(f"count_{c}") != 0, F.col(f"_sum_{c}")).alias(f"sum_{c}"))])


def join_changes(left: DataFrame, left_changes: DataFrame, right: DataFrame, right_changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Changes of the inner join of two weighted tables: what either side's changes meet, multiplicities multiplied."""

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed(FREQ, "_a").join(b.withColumnRenamed(FREQ, "_b"), list(on))
        return both.withColumn(FREQ, F.col("_a") * F.col("_b")).drop("_a", "_b")

    return consolidate(meet(left_changes, right).unionByName(meet(left, right_changes)).unionByName(meet(left_changes, right_changes)))


def maintain(changes: DataFrame, keys: Sequence[str], sums: Sequence[str], name: str, checkpoint: str) -> StreamingQuery:
    """Keep a grouped view of a streaming change feed in the in-memory table `name`."""
    view = grouped_view(changes, keys, sums)
    return view.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
