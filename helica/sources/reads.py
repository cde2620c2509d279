"""Reads of any format, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helica.functions.intervals import Interval, format_intervals
from helica.sources.bam_codec import read_bam_header
from helica.sources.cram import read_cram_header
from helica.sources.detect import read_format, read_format_of_name
from helica.sources.files import expand
from helica.sources.sam import READ_COLUMNS, SamHeader, headers_of, read_sam, read_text_header, select_reads, with_read_key, write_sam


def read_sam_header(path: str) -> SamHeader:
    """The header of a SAM, BAM or CRAM file."""
    kind = read_format(path, trust_names=True)
    if kind == "bam":
        return read_bam_header(path)[0]
    return read_cram_header(path) if kind == "cram" else read_text_header(path)


def read_cram(spark: SparkSession, path: str, intervals: list[Interval] | None = None, unplaced: bool = False, reference: str | None = None, split_size: int | None = None) -> DataFrame:
    """Reads of CRAM files, in parallel over their containers. ``reference`` is a FASTA file that all executors can open, for files that leave bases to it."""
    source = spark.read.format("cram").option("path", path).option("unplaced", str(unplaced).lower())
    for name, value in (("reference", reference), ("splitSize", split_size), ("intervals", format_intervals(intervals) if intervals else None)):
        source = source.option(name, value) if value is not None else source
    return select_reads(source.load(), intervals, unplaced)


def read_bam(spark: SparkSession, path: str, intervals: list[Interval] | None = None, unplaced: bool = False, **options) -> DataFrame:
    """Reads of BAM files, in parallel over ranges of each file; options as of the ``bam`` source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source takes filters
    source = spark.read.format("bam").option("path", path)
    if intervals is not None:
        source = source.option("intervals", format_intervals(intervals)) if intervals else source.option("columns", ",".join(READ_COLUMNS))
    if unplaced:
        source = source.option("unplaced", "true")
    for k, v in options.items():
        source = source.option(k, v)
    rows = source.load()
    return select_reads(rows, intervals, unplaced) if intervals == [] else rows


def load_reads(spark: SparkSession, path: str, intervals: list[Interval] | None = None, unplaced: bool = False, trust_names: bool = True, formats: dict[str, str] | None = None, mode: str = "FAILFAST", key: bool = True, reference: str | None = None) -> DataFrame:
    """Reads of SAM, BAM and CRAM files in any mix, each recognised by name or first bytes, with the sortable ``key``.

    The plan has one branch for BAM, one for CRAM and one for each distinct header
    of SAM files, however many files there are.
    """
    files: dict[str, list[str]] = {}
    for f in expand(path):
        kind = read_format(f, trust_names, formats)
        if kind is None:
            raise ValueError(f"{f} is no file of reads")
        files.setdefault(kind, []).append(f)
    parts = []
    if "bam" in files:
        parts.append(read_bam(spark, ",".join(files["bam"]), intervals, unplaced))
    if "cram" in files:
        parts.append(read_cram(spark, ",".join(files["cram"]), intervals, unplaced, reference))
    if "sam" in files:
        parts += [with_read_key(read_sam(spark, ",".join(some), SamHeader.parse(text), mode, intervals, unplaced)) for text, some in headers_of(files["sam"]).items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows if key else rows.drop("key")


def write_reads(reads: DataFrame, path: str, header: SamHeader | None, fmt: str | None = None, write_header: bool = True, overwrite: bool = False, splitting_index: bool = False, granularity: int = 4096) -> None:
    """Reads as BAM, SAM or CRAM files, one a partition; without ``fmt`` the name tells which. A key column is left out."""
    kind = fmt or read_format_of_name(path)
    if kind is None:
        raise ValueError("the output format is neither given nor in the name")
    if header is None:
        raise ValueError("writing reads needs a header")
    rows = reads.select(*READ_COLUMNS)
    if kind == "sam":
        write_sam(rows, path, header, write_header, "overwrite" if overwrite else "errorifexists")
    elif kind == "bam":
        rows.write.format("bam").mode("overwrite" if overwrite else "append").option("header", header.text or "@CO\tnone\n").option("writeHeader", str(write_header).lower()).option("splittingIndex", str(splitting_index).lower()).option("granularity", granularity).save(path)
    elif kind == "cram":
        rows.write.format("cram").mode("overwrite" if overwrite else "append").option("header", header.text or "@CO\tnone\n").option("writeHeader", str(write_header).lower()).save(path)
    else:
        raise ValueError(f"unknown format {kind}")
