"""Sortable 64-bit keys of reads and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.functions.hashing import hash_read, hash_text

NO_POSITION = 2**31 - 1
UNMAPPED = 0x4


def coordinate_key(ref_index: Column, start: Column) -> Column:
    """``ref_index << 32 | (start - 1)`` for a 1-based start.

    The low word is sign-extended: a start of 0 gives -1 whatever the reference.
    """
    return F.shiftleft(ref_index.cast("long"), 32).bitwiseOR((start.cast("int") - 1).cast("long"))


def read_key(flags: Column, ref_index: Column, start: Column, name: Column, bases: Column, quals: Column, cigar: Column) -> Column:
    """The key of a read: its coordinate, or for a read without one a hash in the place of the start.

    Hashed keys with a negative hash are negative and sort first; ``unplaced_last``
    gives an order that puts them last. A null name counts as ``*``.
    """
    placed = ~((flags.bitwiseAND(F.lit(UNMAPPED)) != 0) | (F.coalesce(ref_index, F.lit(-1)) < 0) | (F.coalesce(start, F.lit(0)) < 0))
    # Python sees all rows, but of placed ones only nulls; the bam source makes its keys while decoding.
    lost = lambda c: F.when(~placed, F.coalesce(c, F.lit("*")))
    hashed = F.shiftleft(F.lit(NO_POSITION).cast("long"), 32).bitwiseOR(hash_read(lost(name), lost(bases), lost(quals), lost(cigar)))
    return F.when(placed, coordinate_key(ref_index, start)).otherwise(hashed)


def unplaced_last(flags: Column, ref_index: Column, start: Column) -> list[Column]:
    """Columns to sort reads by coordinate with all reads without one at the end."""
    unplaced = (flags.bitwiseAND(F.lit(UNMAPPED)) != 0) | (F.coalesce(ref_index, F.lit(-1)) < 0)
    return [unplaced.asc(), ref_index.asc(), start.asc()]


def variant_key(contig_index: Column, contig: Column, start: Column) -> Column:
    """``index << 32 | (start - 1)``; an unknown contig has the low half of its hash as index."""
    # Only names that the header lacks are hashed.
    low = F.shiftright(F.shiftleft(hash_text(F.when(contig_index.isNull(), contig)), 32), 32)
    index = F.coalesce(contig_index.cast("long"), low)
    return F.shiftleft(index, 32).bitwiseOR(start.cast("long") - 1)


def with_contig_index(df: DataFrame, contigs: list[str], contig: str = "contig", name: str = "contig_index") -> DataFrame:
    """Add the place of the contig in the header's list; null if it is not in it."""
    if not contigs:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, F.nullif(F.array_position(F.array(*map(F.lit, contigs)), F.col(contig)), F.lit(0)).cast("int") - 1)
