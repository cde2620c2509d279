"""Queries of the general data problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helica.operators.key_stats import heavy_keys, stats_by_key
from helica.operators.quality_units import unify_qualities
from helica.operators.variant_drift import dictionary_changes, unified_types, unify_variants
from helica.session import cut_lineage
from helica.sources.qseq_lines import parse_qseq_lines
from helica.sources.tables import table


def _drift_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, folder, n) for n in ("bcf_files", "bcf_fields", "variant_rows"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = dictionary_changes(*_drift_tables(spark, folder))
    return changes.select(F.col("version").alias("file_id"), F.col("kind").alias("item_kind"), F.col("name").alias("item_name"), F.col("change").alias("change_kind"))


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """The unified table, with its nested columns as texts (``field=value``, ``.`` for none) and the number of typed values beside them."""
    tables = _drift_tables(spark, folder)
    rows = unify_variants(*tables, cut_lineage(dictionary_changes(*tables)))
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["field"], F.coalesce(e["value"], F.lit(".")))), ";")
    typed = F.size(F.filter(F.concat("format_values", "info_values"), lambda e: e["number"].isNotNull()))
    return rows.select(*(c for c in rows.columns if c not in ("alt_alleles", "format_values", "info_values")), F.array_join("alt_alleles", ",").alias("alt_alleles"), text("format_values").alias("format_values"), text("info_values").alias("info_values"), typed.alias("n_numbers"))


def p1_types(spark: SparkSession, folder: str) -> DataFrame:
    files, fields, variants = _drift_tables(spark, folder)
    return unified_types(files, fields, cut_lineage(dictionary_changes(files, fields, variants)))


def p1_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """Renames by type, count, values and name alone, as if no field had a text."""
    files, fields, variants = _drift_tables(spark, folder)
    changes = dictionary_changes(files, fields.withColumn("field_text", F.lit(None).cast("string")), variants, same_text=False)
    return changes.where(F.col("change") == "renamed").select(F.col("version").alias("file_id"), F.col("kind").alias("item_kind"), F.col("name").alias("item_name"), "old_name")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = parse_qseq_lines(table(spark, folder, "qseq_lines"))
    return bad.select("line_id", "fail_reason")


def p4_valid(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = parse_qseq_lines(table(spark, folder, "qseq_lines"))
    return good.select("line_id", "instrument", "run", "lane", "tile", "xpos", "ypos", F.col("index").alias("index_sequence"), F.col("read").alias("read_no"), F.col("sequence").alias("seq_bases"), "quality", "filter_passed")


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return unify_qualities(table(spark, folder, "fragments").select("fragment_id", "run_id", "lane", "seq_bases", "quality"), table(spark, folder, "seq_runs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    # Repeated rows fold after the unit is known, so that only ids and units are shuffled.
    return _units(spark, folder).where(F.col("quality").isNotNull() & (F.col("unit") != "phred33")).select("fragment_id", F.col("unit").alias("quality_unit")).distinct()


def p5_phred33(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select("fragment_id", F.col("quality_phred33").alias("quality"), F.col("unit").alias("quality_unit"), "unit_source", "unit_ambiguous").distinct()


def p5_by_values(spark: SparkSession, folder: str) -> DataFrame:
    """The unit of every fragment as its values alone tell it, whatever its run states."""
    silent = table(spark, folder, "seq_runs").select("run_id", F.lit(None).cast("string").alias("quality_encoding"), F.lit(None).cast("string").alias("run_note"))
    units = unify_qualities(table(spark, folder, "fragments").select("fragment_id", "run_id", "lane", "seq_bases", "quality"), silent)
    return units.select("fragment_id", F.col("unit").alias("quality_unit"), "unit_ambiguous").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "alignments"), "record_key").select("record_key")


def p6_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats_by_key(table(spark, folder, "alignments"), "record_key", first_load=F.min("loaded_at"), last_load=F.max("loaded_at"), mean_mapq=F.avg("mapq"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p1_types, p1_likeness, p4_found, p4_valid, p5_found, p5_phred33, p5_by_values, p6_found, p6_key_stats)}
