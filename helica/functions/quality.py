"""Base quality notations with an ASCII offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First characters of both notations, and the highest score that each may hold.
SANGER_OFFSET, ILLUMINA_OFFSET, MAX_SCORE = 33, 64, 62
SANGER_MAX = 93
_PHRED64 = "".join(map(chr, range(64, 127)))
_PHRED33 = "".join(map(chr, range(33, 96)))


def illumina_to_sanger(quality: Column, strict: bool = True) -> Column:
    """Phred+64 as Phred+33. A character outside 64 to 126 is an error, or null if not ``strict``."""
    bad = F.raise_error(F.concat(F.lit("base quality score out of range for Phred+64: "), quality)) if strict else F.lit(None)
    return F.when(quality.rlike(r"^[@-~]*\z"), F.translate(quality, _PHRED64, _PHRED33)).when(quality.isNotNull(), bad)


def sanger_to_illumina(quality: Column, strict: bool = True) -> Column:
    """Phred+33 as Phred+64. Characters outside 33 to 95 have no place in Phred+64 and are an error, or null if not ``strict``."""
    bad = F.raise_error(F.concat(F.lit("base quality score out of range for Phred+64: "), quality)) if strict else F.lit(None)
    return F.when(quality.rlike(r"^[!-_]*\z"), F.translate(quality, _PHRED33, _PHRED64)).when(quality.isNotNull(), bad)


def convert_quality(quality: Column, current: str, target: str, strict: bool = True) -> Column:
    """From ``sanger`` to ``illumina`` or back; the same notation twice is an error."""
    if current == target:
        raise ValueError(f"current and target encodings are the same: {current}")
    table = {("illumina", "sanger"): illumina_to_sanger, ("sanger", "illumina"): sanger_to_illumina}
    if (current, target) not in table:
        raise ValueError(f"no conversion from {current} to {target}")
    return table[current, target](quality, strict)


def first_bad_quality(quality: Column, encoding: str = "sanger") -> Column:
    """The index of the first character that the notation does not allow, -1 if there is none."""
    allowed = {"sanger": "[^!-~]", "illumina": "[^@-~]"}
    if encoding not in allowed:
        raise ValueError(f"unknown encoding {encoding}")
    return F.regexp_instr(quality, F.lit(allowed[encoding])) - 1


def checked_quality(quality: Column, encoding: str, strict: bool = True) -> Column:
    """Quality as Phred+33 from a file in ``encoding``; scores out of range are an error, or null if not ``strict``."""
    if encoding == "illumina":
        return illumina_to_sanger(quality, strict)
    if encoding != "sanger":
        raise ValueError(f"unknown encoding {encoding}")
    bad = F.raise_error(F.concat(F.lit("base quality score out of range for Phred+33: "), quality)) if strict else F.lit(None)
    return F.when(first_bad_quality(quality) < 0, quality).when(quality.isNotNull(), bad)
