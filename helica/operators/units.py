"""One unit for a quantity that sources record in different units."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.operators.rejects import computed_once

#: Residuals closer than this are a tie.
TIE = 1e-9


@dataclass(frozen=True)
class Reading:
    """One way to read a row's values.

    ``residual`` is how far the row misses the identities that tie its columns
    together if the values are in ``unit``, as a sum of absolute logarithms of
    ratios; null where that reading is impossible. ``value`` is the quantity in
    the common unit.
    """

    unit: str
    residual: Column
    value: Column


def resolve_units(df: DataFrame, readings: list[Reading], claim: Column, max_residual: float) -> DataFrame:
    """Add ``unit``, ``unit_source`` and ``unit_ambiguous``.

    A unit that the source states (``claim``) holds. Otherwise the reading with
    the least log residual is taken, if it is at most ``max_residual``.
    ``unit_ambiguous`` is true where another reading fits as well: then the
    unit is null, as the identities leave more than one solution.
    ``unit_source`` is ``stated``, ``values`` or null.
    """
    stated = computed_once(df, _claim=claim)
    # Residuals are measured once a row, and only where the source states nothing.
    measured = computed_once(stated, _misses=F.when(F.col("_claim").isNull(), F.array(*(F.struct(r.residual.alias("residual"), F.lit(r.unit).alias("unit")) for r in readings))))
    ranked = computed_once(measured, _fits=F.array_sort(F.filter("_misses", lambda m: m["residual"] <= max_residual))).drop("_misses")
    first, second = F.get("_fits", F.lit(0)), F.get("_fits", F.lit(1))
    tied = F.coalesce((second["residual"] - first["residual"]) <= TIE, F.lit(False))
    return (
        ranked.withColumn("unit_ambiguous", F.col("_claim").isNull() & tied)
        .withColumn("unit", F.coalesce("_claim", F.when(~tied, first["unit"])))
        .withColumn("unit_source", F.when(F.col("_claim").isNotNull(), "stated").when(F.col("unit").isNotNull(), "values"))
        .drop("_fits", "_claim")
    )


def convert(df: DataFrame, readings: list[Reading], name: str) -> DataFrame:
    """Add ``name``: the value in the common unit under the row's ``unit``, null where it has none."""
    value = reduce(lambda c, r: c.when(F.col("unit") == r.unit, r.value), readings[1:], F.when(F.col("unit") == readings[0].unit, readings[0].value))
    return df.withColumn(name, value)
