"""Joins that stay balanced when a key is hot and broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of narrow columns that may be broadcast; about 20 MB at 100 bytes a row.
MAX_BROADCAST_ROWS = 200_000
SALTS = 32


def is_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, weight: Column | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than it must.

    Where rows hold arrays, ``weight`` is the number of narrow values in a row, and
    their sum is held against ``max_rows``.
    """
    if weight is not None:
        return (df.agg(F.sum(weight)).first()[0] or 0) <= max_rows
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def keyed_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
    weight: Column | None = None,
) -> DataFrame:
    """Join ``large`` to ``small``, which has one row a key.

    A small side with a proven size is broadcast. Any other is copied ``salts``
    times and the large side spread over the copies by a hash of the row, so a key
    that holds a third of the rows is split over ``salts`` tasks, and a task that
    runs again does the same. Null keys match nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    if is_bounded(small, max_rows, weight):
        return large.join(F.broadcast(small), keys, how)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hashed = ["`" + f.name.replace("`", "``") + "`" for f in large.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
