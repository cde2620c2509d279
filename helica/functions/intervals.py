"""Genomic intervals: contig and a closed range of 1-based positions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helica.operators.joins import is_bounded

#: Intervals up to which a filter is one predicate; more are joined.
MAX_IN_PREDICATE = 64
#: Positions of a bin of the join.
BIN = 1 << 14


class Interval(NamedTuple):
    contig: str
    start: int
    stop: int


def parse_intervals(text: str | None) -> list[Interval] | None:
    """``chr1:1-100,chr2:5-9``: contig up to the last colon, then start and stop. None for None, no interval for an empty text."""
    if text is None:
        return None
    return [_parse_one(part) for part in text.split(",")] if text else []


def _parse_one(part: str) -> Interval:
    contig, colon, span = part.rpartition(":")
    start, dash, stop = span.partition("-")
    if not (colon and dash and contig and _digits(start) and _digits(stop)):
        raise ValueError(f"not an interval: {part!r}")
    return Interval(contig, int(start), int(stop))


def _digits(s: str) -> bool:
    return s.isascii() and s.isdigit()


def format_intervals(intervals: list[Interval]) -> str:
    return ",".join(f"{i.contig}:{i.start}-{i.stop}" for i in intervals)


def merge_intervals(intervals: list[Interval]) -> list[Interval]:
    """Sorted, with overlapping and adjacent ones joined, so that no row counts twice."""
    merged: list[Interval] = []
    for i in sorted(map(Interval._make, intervals)):
        if merged and merged[-1].contig == i.contig and i.start <= merged[-1].stop + 1:
            merged[-1] = merged[-1]._replace(stop=max(merged[-1].stop, i.stop))
        else:
            merged.append(i)
    return merged


def overlaps(intervals: list[Interval], contig: Column, start: Column, end: Column) -> Column:
    """Whether a row touches any interval; false for every row if there is none."""
    tests = [(contig == i.contig) & (start <= i.stop) & (end >= i.start) for i in merge_intervals(intervals)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def filter_by_intervals(df: DataFrame, intervals: list[Interval] | None, contig: str = "contig", start: str = "start", end: str = "end", unplaced: bool = False) -> DataFrame:
    """Rows that touch an interval; with ``unplaced`` also those without a contig. None keeps all rows.

    Few intervals are one predicate, which reaches the scan. Many are joined as a
    table of bins of 16384 positions. Either way a row comes out once, however many
    intervals it touches, and equal rows as often as they stand in ``df``.
    """
    if intervals is None:
        return df
    merged = merge_intervals(intervals)
    lost = F.col(contig).isNull()
    if len(merged) <= MAX_IN_PREDICATE:
        hit = overlaps(merged, F.col(contig), F.col(start), F.col(end))
        return df.where(F.coalesce(hit, F.lit(False)) | lost if unplaced else hit)
    table = df.sparkSession.createDataFrame(merged, "_contig string, _start long, _stop long")
    found = interval_semi_join(df.where(~lost), table, contig, start, end)
    return found.unionByName(df.where(lost)) if unplaced else found


def interval_semi_join(df: DataFrame, intervals: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """Rows of ``df`` that touch a row of ``intervals`` (``_contig``, ``_start``, ``_stop``).

    Each row looks only into the bins it covers. Intervals of a proven size are
    broadcast, others shuffled by contig and bin, so a long contig is spread.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.greatest(F.col(a), F.col(b)) / BIN)))
    sides = intervals.withColumn("_bin", bins("_start", "_stop"))
    bounded = is_bounded(sides)
    if bounded:
        sides = F.broadcast(sides)
    short = (F.floor(F.col(end) / BIN) - F.floor(F.col(start) / BIN)) <= 0
    touch = lambda rows: (rows[contig] == sides["_contig"]) & (rows["_bin"] == sides["_bin"]) & (rows[start] <= sides["_stop"]) & (rows[end] >= sides["_start"])
    one = df.where(short).withColumn("_bin", F.floor(F.col(start) / BIN))
    near = one.join(sides, touch(one), "left_semi").drop("_bin")
    # A row over several bins looks at the first of them that any interval reaches. What lies there and in the next such bin
    # decides, as all bins between its first and last are covered whole. So each row is kept or not once, without an id.
    along = Window.partitionBy("_contig").orderBy("_bin")
    low, high = F.greatest("_start", F.col("_bin") * BIN), F.least("_stop", F.col("_bin") * BIN + BIN - 1)
    reached = intervals.withColumn("_bin", bins("_start", "_stop")).groupBy("_contig", "_bin").agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    reached = reached.select("*", F.lag("_bin").over(along).alias("_before"), F.lead("_bin").over(along).alias("_next"), F.lead("_low").over(along).alias("_next_low"))
    if bounded:
        reached = F.broadcast(reached)
    wide = df.where(~short).withColumn("_bin", bins(start, end))
    first, last, at = F.floor(wide[start] / BIN), F.floor(wide[end] / BIN), wide["_bin"]
    here = F.when(at == first, reached["_high"] >= wide[start]).when(at == last, reached["_low"] <= wide[end]).otherwise(F.lit(True))
    later = (at == first) & ((reached["_next"] < last) | ((reached["_next"] == last) & (reached["_next_low"] <= wide[end])))
    only = (reached["_before"].isNull() | (reached["_before"] < first)) & (here | F.coalesce(later, F.lit(False)))
    far = wide.join(reached, (wide[contig] == reached["_contig"]) & (at == reached["_bin"]) & only, "left_semi").drop("_bin")
    return near.unionByName(far)
