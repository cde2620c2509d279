"""Virtual offsets: block address (48 bits) and offset in the block (16 bits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(block: Column, inside: Column) -> Column:
    return F.shiftleft(block.cast("long"), 16).bitwiseOR(inside.cast("long"))


def block_of(offset: Column) -> Column:
    return F.shiftrightunsigned(offset.cast("long"), 16)


def inside_of(offset: Column) -> Column:
    return offset.cast("long").bitwiseAND(F.lit(0xFFFF))


def shifted(offset: Column, bytes_: Column) -> Column:
    """The offset after ``bytes_`` compressed bytes were put in front of the file."""
    return pack(block_of(offset) + bytes_.cast("long"), inside_of(offset))


def split_length(start: Column, end: Column) -> Column:
    """Compressed bytes between two offsets; bytes inside the block if both are in one block."""
    apart = block_of(end) - block_of(start)
    return F.when(apart == 0, inside_of(end) - inside_of(start)).otherwise(apart)
