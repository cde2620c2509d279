"""Order within groups without one task for a whole group.

A group's order key is cut into chunks of a fixed span. Windows run inside a
chunk, and only one row a chunk takes part in the window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(df: DataFrame, group: str, order: str, tie: str, value: str, span: int = 4096) -> DataFrame:
    """Add ``previous``: ``value`` of the row before, by ``order`` and then ``tie``, in its group.

    Rows with a null group or order have no neighbours and get null. ``order``
    is an integer; one chunk holds ``span`` of its values, so its size has a bound
    as long as the order is (nearly) unique in a group.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(span)))
    usable = F.col(group).isNotNull() & F.col(order).isNotNull()
    inner = Window.partitionBy(group, "_chunk").orderBy(order, tie)
    within = chunked.where(usable).withColumn("_in", F.lag(F.struct(value)).over(inner))
    last = (
        chunked.where(usable)
        .groupBy(group, "_chunk")
        .agg(F.max_by(F.struct(value), F.struct(order, tie)).alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.partitionBy(group).orderBy("_chunk")))
        .select(group, "_chunk", "_before")
    )
    joined = within.join(last, [group, "_chunk"], "left")
    found = joined.withColumn("previous", F.coalesce("_in", "_before")[value]).drop("_in", "_before", "_chunk")
    rest = chunked.where(~usable | usable.isNull()).drop("_chunk")
    return found.unionByName(rest.withColumn("previous", F.lit(None).cast(df.schema[value].dataType)))


def running_start(df: DataFrame, groups: list[str], chunk: str, order: list[str], weight: Column) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over the rows before this one in its group.

    ``chunk`` is a column that rises with ``order`` and whose size has a bound.
    """
    weighed = df.withColumn("_w", weight.cast("long"))
    inner = Window.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        weighed.groupBy(*groups, chunk)
        .agg(F.sum("_w").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
        .drop("_sum")
    )
    local = weighed.withColumn("_local", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    return local.join(sums, [*groups, chunk]).withColumn("start", F.col("_base") + F.col("_local")).drop("_w", "_local", "_base")
