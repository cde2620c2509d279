"""FASTQ and QSEQ files as fragments, and fragments as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helica.functions.names import fastq_id, passes_qc, qseq_key, qseq_line, with_run_id
from helica.functions.quality import checked_quality, sanger_to_illumina
from helica.sources.files import expand
from helica.sources.qseq_lines import parse_qseq_lines
from helica.sources.text_out import checked_mode, split_once, without_malformed

FRAGMENT_COLUMNS = ("key", "sequence", "quality", "instrument", "run_number", "flowcell_id", "lane", "tile", "xpos", "ypos", "read", "filter_passed", "control_number", "index_sequence")


def read_fastq(spark: SparkSession, path: str, encoding: str = "sanger", filter_failed_qc: bool = False, sticky: bool = False, split_size: int | None = None) -> DataFrame:
    """Fragments of FASTQ files. Failed reads go before qualities are checked, so their qualities may be anything.

    ``sticky`` stops reading identifiers at a file's first one of another form.
    """
    source = spark.read.format("fastq").option("path", path)
    raw = (source.option("splitSize", split_size) if split_size else source).load()
    named = with_run_id(raw, "key", sticky, "file", "offset")
    if filter_failed_qc:
        named = named.where(passes_qc(F.col("filter_passed")))
    return named.withColumn("quality", checked_quality(F.col("quality"), encoding)).select(*FRAGMENT_COLUMNS)


def parse_qseq(lines: DataFrame, encoding: str = "illumina", filter_failed_qc: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Fragments of QSEQ lines (``value``): exactly 11 fields split by tabs, else an error, or left out with ``DROPMALFORMED``."""
    mode = checked_mode(mode)
    f = split_once(lines, "value").withColumnRenamed("_line", "value")
    at = lambda i: F.get("_f", F.lit(i))
    numbers = F.array(*(at(i).try_cast("int") for i in (1, 2, 3, 4, 5, 7)))
    bad = (F.size("_f") != 11) | F.exists(numbers, lambda n: n.isNull())
    f = without_malformed(f, bad, mode, "QSEQ", "value")
    parts = {"instrument": at(0), "run_number": at(1).cast("int"), "lane": at(2).cast("int"), "tile": at(3).cast("int"), "xpos": at(4).cast("int"), "ypos": at(5).cast("int"), "read": at(7).cast("int")}
    rows = f.select(
        qseq_key({k: at(i) for k, i in zip(("instrument", "run_number", "lane", "tile", "xpos", "ypos", "read"), (0, 1, 2, 3, 4, 5, 7))}).alias("key"),
        F.translate(at(8), ".", "N").alias("sequence"), at(9).alias("quality"), *(c.alias(n) for n, c in parts.items()),
        F.lit(None).cast("string").alias("flowcell_id"), (~at(10).startswith("0")).alias("filter_passed"), F.lit(None).cast("int").alias("control_number"),
        F.when(~at(6).startswith("0"), F.translate(at(6), ".", "N")).alias("index_sequence"),
    )
    if filter_failed_qc:
        rows = rows.where(passes_qc(F.col("filter_passed")))
    return rows.withColumn("quality", checked_quality(F.col("quality"), encoding)).select(*FRAGMENT_COLUMNS)


def read_qseq(spark: SparkSession, path: str, encoding: str = "illumina", filter_failed_qc: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Fragments of QSEQ files."""
    return parse_qseq(spark.read.text(expand(path)), encoding, filter_failed_qc, mode)


def read_qseq_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of QSEQ files, and the lines that are no valid record with the reason."""
    return parse_qseq_lines(spark.read.text(expand(path)).withColumnRenamed("value", "raw_line"))


#: What makes two fragments equal: everything but their keys.
EQUALITY = ("sequence", "quality", "instrument", "run_number", "flowcell_id", "lane", "tile", "xpos", "ypos", "read", "filter_passed", "control_number", "index_sequence")


def same_fragment(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = EQUALITY) -> Column:
    """Whether two fragments are equal: in all columns, null like null, whatever their keys."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def fold_equal(fragments: DataFrame, columns: tuple[str, ...] = EQUALITY, count: str = "n") -> DataFrame:
    """Distinct fragments and how often each comes; one hash aggregation, in which null equals null."""
    return fragments.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def _columns(df: DataFrame) -> dict:
    """The columns of fragments; those that ``df`` lacks are null."""
    have = set(df.columns)
    return {c: F.col(c) if c in have else F.lit(None) for c in FRAGMENT_COLUMNS}


def format_fastq(fragments: DataFrame, encoding: str = "sanger") -> DataFrame:
    """Four lines a fragment, as one text. A key is the name; without one it is made from the other columns."""
    c = _columns(fragments)
    quality = sanger_to_illumina(c["quality"]) if encoding == "illumina" else c["quality"]
    if encoding not in ("sanger", "illumina"):
        raise ValueError(f"unknown encoding {encoding}")
    return fragments.select(F.concat(F.lit("@"), F.coalesce(c["key"], fastq_id(c)), F.lit("\n"), c["sequence"], F.lit("\n+\n"), quality).alias("value"))


def format_qseq(fragments: DataFrame, encoding: str = "illumina") -> DataFrame:
    """A line a fragment."""
    if encoding not in ("sanger", "illumina"):
        raise ValueError(f"unknown encoding {encoding}")
    return fragments.select(qseq_line(_columns(fragments), encoding == "illumina").alias("value"))


def write_fastq(fragments: DataFrame, path: str, encoding: str = "sanger", compression: str = "none", mode: str = "errorifexists") -> None:
    format_fastq(fragments, encoding).write.mode(mode).option("compression", compression).text(path)


def write_qseq(fragments: DataFrame, path: str, encoding: str = "illumina", compression: str = "none", mode: str = "errorifexists") -> None:
    format_qseq(fragments, encoding).write.mode(mode).option("compression", compression).text(path)


def read_fasta(spark: SparkSession, path: str, split_size: int | None = None) -> DataFrame:
    """The sequence lines of a FASTA file."""
    source = spark.read.format("fasta").option("path", path)
    return (source.option("splitSize", split_size) if split_size else source).load()
