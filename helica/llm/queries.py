"""Queries of the operators for training data, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helica.llm.contamination import find_leaks
from helica.llm.encoding import find_garbled, misread
from helica.llm.packing import CAPACITY, fill_report, pack, token_counts
from helica.llm.splitting import oversized_items, split_items
from helica.llm.sql import SQL as SQL
from helica.llm.terms import index_terms, mark_terms
from helica.session import cut_lineage
from helica.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return mark_terms(table(spark, folder, "fragments"), "fragment_id", index_terms(F.col("index_sequence"))).withColumnRenamed("term", "index_term")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where(F.col("term_mark").isNotNull()).select("index_term", "term_mark")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized_items(table(spark, folder, "bam_files"), table(spark, folder, "bam_offsets"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_items(table(spark, folder, "bam_files"), table(spark, folder, "bam_offsets"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return pack(token_counts(docs, "doc_id", "text"), "doc_id", docs.count())


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p7_containers(spark, folder))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What an arrangement has to keep: every token of every document once, no container over its capacity, nothing cut that fits, little room unused."""
    docs = _documents(spark, folder)
    packed = cut_lineage(pack(token_counts(docs, "doc_id", "text"), "doc_id", docs.count()))
    pieces = Window.partitionBy("doc_id").orderBy("piece_no")
    places = Window.partitionBy("container_id").orderBy("container_start", "token_start")
    size = F.col("token_end") - F.col("token_start")
    seen = packed.withColumn("gap", F.col("token_start") != F.coalesce(F.lag("token_end").over(pieces), F.lit(0))).withColumn("overlap", F.coalesce(F.col("container_start") < F.lag(F.col("container_start") + size).over(places), F.lit(False)))
    each = seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("token_end").alias("tokens"), F.count_if("gap").alias("gaps"), F.count_if("overlap").alias("overlaps"), F.count_if(F.col("container_start") + size > CAPACITY).alias("over"))
    whole = F.count_if((F.col("n") == 1) | (F.col("tokens") > CAPACITY))
    checks = each.agg(F.count(F.lit(1)).alias("n_documents"), whole.alias("n_whole_or_oversized"), F.sum("gaps").alias("n_gaps"), F.sum("over").alias("n_too_full"), F.sum("overlaps").alias("n_overlaps"))
    return checks.withColumn("under_five_percent_unused", fill_report(packed).select(F.col("unused_share") < 0.05).scalar())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_documents(spark, folder), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_documents(spark, folder), table(spark, folder, "eval_items"), paraphrase=True)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(_documents(spark, folder), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(_documents(spark, folder), "doc_id", "text")


#: A line with letters of many kinds, and the encodings it is misread in, by the number of the document.
PLANTED, MISREAD = "Übermäßig naïve «données» d’été — señor, smörgåsbord “quoted” ½ × 3", ("cp1252", "cp1250", "mac_roman", "cp437", "cp850")


def p9_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with one more line that was decoded in a wrong encoding, once or twice: whether it is found, and the line comes back."""
    docs = _documents(spark, folder)
    garbled = [g for codec in MISREAD for g in (misread(PLANTED, codec), misread(misread(PLANTED, codec), codec))]
    line = F.element_at(F.array(*map(F.lit, garbled)), (F.pmod("doc_id", F.lit(len(garbled))) + 1).cast("int"))
    planted = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))
    found = find_garbled(planted, "doc_id", "text").select("doc_id", F.col("restored").endswith("\n" + PLANTED).alias("restored"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("restored").isNotNull().alias("found"), F.coalesce("restored", F.lit(False)).alias("restored"))


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p3_found, p3_pieces, p7_containers, p7_fill, p7_invariants, p8_found, p8_leaks, p9_found, p9_restored, p9_planted)}
