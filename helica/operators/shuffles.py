"""Shuffles of reads and variants by name and by coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_by_read_name(reads: DataFrame, partitions: int | None = None) -> DataFrame:
    """All reads of a name in one partition, next to each other; each read once."""
    return _together(reads, F.col("read_name"), partitions).sortWithinPartitions("read_name")


def group_by_variant(variants: DataFrame, partitions: int | None = None) -> DataFrame:
    """All variants of a contig and ID next to each other."""
    name = F.concat_ws(":", "contig", F.coalesce("id", F.lit(".")))
    return _together(variants, name, partitions).sortWithinPartitions("contig", "id")


def _together(df: DataFrame, key, partitions: int | None) -> DataFrame:
    return df.repartition(partitions, key) if partitions else df.repartition(key)


def sort_by_coordinate(reads: DataFrame) -> DataFrame:
    """Reads in the order of their key, over all partitions (range partitioned, so parts follow each other)."""
    return reads.orderBy("key")
