"""Streams of the line formats: new files of a folder as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helica.sources.fragments import parse_qseq
from helica.sources.qseq_lines import parse_qseq_lines
from helica.sources.sam import SamHeader, parse_sam
from helica.sources.vcf import VcfHeader, parse_vcf


def _lines(spark: SparkSession, folder: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def stream_qseq(spark: SparkSession, folder: str, files_per_batch: int | None = None, **options) -> DataFrame:
    """Fragments of QSEQ files."""
    return parse_qseq(_lines(spark, folder, files_per_batch), **options)


def stream_qseq_with_rejects(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected lines, as two streams."""
    return parse_qseq_lines(_lines(spark, folder, files_per_batch).withColumnRenamed("value", "raw_line"))


def stream_sam(spark: SparkSession, folder: str, header: SamHeader, files_per_batch: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Reads of SAM files that share a header."""
    return parse_sam(_lines(spark, folder, files_per_batch), header, mode=mode)


def stream_vcf(spark: SparkSession, folder: str, header: VcfHeader, files_per_batch: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Variants of VCF files that share a header."""
    return parse_vcf(_lines(spark, folder, files_per_batch), header, mode=mode)
