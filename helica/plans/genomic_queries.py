"""Queries of the genomic operators on the given tables.

Records of the formats are made from the tables, go through the real writers and
parsers, and come back; the SQL beside them takes the expected columns directly
from the tables.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helica.functions import offsets
from helica.functions.hashing import hash_binary, hash_text
from helica.functions.intervals import Interval, filter_by_intervals, format_intervals, interval_semi_join, merge_intervals, parse_intervals
from helica.functions.keys import coordinate_key
from helica.functions.names import fastq_id, parse_boolean, parse_run_id, qseq_key
from helica.functions.quality import convert_quality, first_bad_quality, illumina_to_sanger, sanger_to_illumina
from helica.operators.joins import keyed_join
from helica.operators.ordered import running_start
from helica.operators.shuffles import group_by_read_name, group_by_variant, sort_by_coordinate
from helica.session import register_sources
from helica.sources import bgzf
from helica.sources.bam import BamReader, bam_kind
from helica.sources.bam_codec import decode_records, header_bytes, parse_header, read_bam_header
from helica.sources.bam_index import DEFAULT_GRANULARITY, BlockIndex, SplittingIndex, build_bai, build_block_index, build_splitting_index
from helica.sources.detect import read_format, variant_format
from helica.sources.files import expand, is_remote, local, size_of
from helica.sources.fragments import fold_equal, format_qseq, read_fasta, read_fastq, read_qseq, write_fastq, write_qseq
from helica.sources.merge import merge_reads, merge_variants, part_files
from helica.sources.reads import load_reads, read_bam, read_cram, read_sam_header, write_reads
from helica.sources.records import first_record, record_slices, resolve
from helica.sources.sam import SamHeader, check_traversal, cigar_steps, format_sam, index_of, parse_sam, read_sam, reference_span, select_reads, tag_structs, with_read_key
from helica.sources.tables import table
from helica.sources.vcf import VcfHeader, format_vcf, genotypes, parse_vcf, read_variants, read_vcf_header, write_vcf
from helica.tools import main as tools_main

CONTIGS = [(f"chr{i}", 250_000_000) for i in [*range(1, 23), "X"]]
HEADER = SamHeader.of_contigs(CONTIGS, "unsorted")
INTERVALS = "chr3:1000000-30000000,chr7:500-9000000,chr3:20000000-40000000,chr15:1-60000000"


def work_folder(spark: SparkSession) -> str:
    """A new folder for files: in the shared folder of the session, or a temporary one with a local master."""
    import atexit

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if shared and is_remote(shared):
        raise ValueError("files of reads and variants are written through a shared file system, not to a URI")
    base = local(shared) if shared else tempfile.gettempdir()
    folder = os.path.join(base, f"helica-{uuid.uuid4().hex}")
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, True)
    return folder


# --- records from the tables -------------------------------------------------


def header_of(spark: SparkSession, folder: str) -> SamHeader:
    """``HEADER``, with the contigs behind its own that only the alignments have, by the numbers in their names: files need every contig of their reads."""
    a = table(spark, folder, "alignments")
    seen = a.select("contig", F.greatest("start_pos", "end_pos").alias("last")).unionAll(a.select("mate_contig", "mate_start"))
    found = seen.where((F.col("contig") != "") & ~F.col("contig").isin(HEADER.names)).groupBy("contig").agg(F.coalesce(F.max("last"), F.lit(0)).alias("last")).collect()
    if not found:
        return HEADER
    by_number = lambda r: [(int(x) if x.isdecimal() else -1, x) for x in re.split(r"(\d+)", r["contig"])]
    return SamHeader.of_contigs([*HEADER.contigs, *((r["contig"], max(r["last"], 250_000_000)) for r in sorted(found, key=by_number))], "unsorted")


def reads_of(spark: SparkSession, folder: str, header: SamHeader = HEADER) -> DataFrame:
    """The alignments as reads; nulls take the values that the formats have for them."""
    a = table(spark, folder, "alignments")
    mate = F.col("mate_contig")
    names = header.names
    return a.select(
        F.concat_ws("|", "read_name", "read_id", F.date_format("loaded_at", "yyyyMMddHHmmssSSSSSS")).alias("read_name"), F.coalesce("flags", F.lit(0)).alias("flags"), index_of(names, F.col("contig")).alias("ref_index"), "contig",
        F.coalesce("start_pos", F.lit(0)).alias("start"), F.coalesce("end_pos", "start_pos", F.lit(0)).alias("end"), F.coalesce("mapq", F.lit(255)).alias("mapq"), F.coalesce("cigar", F.lit("*")).alias("cigar"),
        index_of(names, mate).alias("mate_ref_index"), mate.alias("mate_contig"), F.coalesce("mate_start", F.lit(0)).alias("mate_start"), F.coalesce("insert_size", F.lit(0)).alias("insert_size"), F.coalesce("bases", F.lit("*")).alias("bases"), F.coalesce("quals", F.lit("*")).alias("quals"), F.coalesce("opt_tags", F.lit("")).alias("tags"),
    )


def fragments_of(spark: SparkSession, folder: str) -> DataFrame:
    """The fragments with values for what is null; a quality in another notation is made anew from the bases."""
    f = table(spark, folder, "fragments")
    bases = F.coalesce("seq_bases", F.lit("N"))
    index = F.nullif(F.regexp_replace(F.upper("index_sequence"), "[^ACGTN]", ""), F.lit(""))
    kept = F.col("quality").rlike(r"^[!-_]+\z") & (F.length("quality") == F.length(bases))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.select(
        F.coalesce("instrument", F.lit("NA")).alias("instrument"), zero("run_number").alias("run_number"), F.coalesce("flowcell_id", F.lit("")).alias("flowcell_id"), zero("lane").alias("lane"), zero("tile").alias("tile"), zero("xpos").alias("xpos"), zero("ypos").alias("ypos"),
        F.coalesce("read_no", F.lit(1)).alias("read"), F.coalesce("filter_passed", F.lit(True)).alias("filter_passed"), zero("control_number").alias("control_number"), index.alias("index_sequence"), bases.alias("sequence"),
        F.when(kept, F.col("quality")).otherwise(F.translate(bases, "ACGTN", "!5?IJ")).alias("quality"),
    )


FRAGMENT = ["instrument", "run_number", "lane", "tile", "xpos", "ypos", "read", "filter_passed", "index_sequence", "sequence", "quality"]

VCF_CONTIGS = [*CONTIGS, ("chrY", 250_000_000), ("chrM", 20_000)]
VCF_TOP = "\n".join(
    [
        "##fileformat=VCFv4.2", *(f"##contig=<ID={n},length={size}>" for n, size in VCF_CONTIGS),
        '##INFO=<ID=PR,Number=1,Type=String,Description="Name of the contig">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="A number">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="Flag">',
        '##FILTER=<ID=q10,Description="Low">', '##FILTER=<ID=s50,Description="Few">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2",
    ]
) + "\n"
VCF_HEADER = VcfHeader.parse(VCF_TOP)
#: Genotypes by the last digit of a variant's number.
CALLS = ("0/1", "1|1", "./.", "0|0", "1/0")


def variant_lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """The variant rows as lines of VCF text, with INFO and genotypes that one header describes."""
    v, n = table(spark, folder, "variant_rows"), F.col("variant_id")
    call = F.element_at(F.array(*map(F.lit, CALLS)), (n % 5 + 1).cast("int"))
    qual = F.when(F.col("qual").isNull(), ".").when(F.col("qual") == F.floor("qual"), F.col("qual").cast("long").cast("string")).otherwise(F.col("qual").cast("string"))
    info = F.concat(F.lit("PR="), F.substring("contig", F.lit(4), F.length("contig")), F.lit(";DP="), n * 7 % 1000, F.when(n % 2 == 0, ";DB").otherwise(""))
    gq = F.when(n % 3 == 0, ".").otherwise((n % 99).cast("string"))
    return v.select(F.concat_ws("\t", "contig", "pos", F.concat(F.lit("v"), n), "ref_allele", "alt_alleles", qual, F.coalesce("filters", F.lit(".")), info, F.lit("GT:GQ"), F.concat_ws(":", call, gq), F.lit("1|1:.")).alias("value"))


def variants_of(spark: SparkSession, folder: str) -> DataFrame:
    return parse_vcf(variant_lines_of(spark, folder), VCF_HEADER)


# --- queries -----------------------------------------------------------------


def _file(spark: SparkSession, name: str) -> str:
    register_sources(spark)
    return os.path.join(work_folder(spark), name)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _qseq(spark: SparkSession, folder: str) -> str:
    at = _file(spark, "reads_qseq.txt")
    write_qseq(fragments_of(spark, folder), at)
    return at


def qseq_roundtrip(spark, folder):
    return read_qseq(spark, _qseq(spark, folder)).select("key", *FRAGMENT)


def qseq_qc_filter(spark, folder):
    return read_qseq(spark, _qseq(spark, folder), filter_failed_qc=True).select("instrument", "run_number", "lane", "filter_passed")


def qseq_line_text(spark, folder):
    return format_qseq(fragments_of(spark, folder))


def qseq_key_text(spark, folder):
    f = fragments_of(spark, folder)
    return f.select(qseq_key({c: F.col(c) for c in f.columns}).alias("key"))


def fastq_roundtrip(spark, folder):
    at = _file(spark, "reads.fastq")
    write_fastq(fragments_of(spark, folder), at)
    return read_fastq(spark, at, split_size=1 << 18).select("flowcell_id", "control_number", *FRAGMENT)


def fastq_compressed(spark, folder):
    """Through gzip files, each read as a whole."""
    at = _file(spark, "reads.fastq")
    write_fastq(fragments_of(spark, folder), at, compression="gzip")
    return read_fastq(spark, at).select("flowcell_id", "control_number", *FRAGMENT)


def fastq_illumina_id(spark, folder):
    f = fragments_of(spark, folder)
    name = f.select(fastq_id({c: F.col(c) for c in f.columns}).alias("name"))
    return name.select("name", *(c.alias(n) for n, c in parse_run_id(F.col("name")).items()))


def fastq_read_number(spark, folder):
    name = table(spark, folder, "lineitem").select(F.concat(F.lit("r"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/"), F.col("l_linenumber"))).otherwise("")).alias("name"))
    return name.select("name", parse_run_id(F.col("name"))["read"].alias("read"))


def _qualities(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("digits"))


def quality_illumina_to_sanger(spark, folder):
    q = _qualities(spark, folder).withColumn("quality", F.translate("digits", "0123456789", "@ABCDEFGHI"))
    return q.select("l_orderkey", "l_linenumber", illumina_to_sanger(F.col("quality")).alias("sanger"))


def quality_sanger_to_illumina(spark, folder):
    q = _qualities(spark, folder)
    return q.select("l_orderkey", "l_linenumber", sanger_to_illumina(F.col("digits")).alias("illumina"))


def quality_verify(spark, folder):
    q = _qualities(spark, folder).withColumn("quality", F.translate("digits", "7", "\t"))
    return q.select("l_orderkey", "l_linenumber", first_bad_quality(F.col("quality")).alias("first_bad"))


def fragment_equality(spark, folder):
    """Null-safe equality of all columns: distinct fragments and how often each comes."""
    f = table(spark, folder, "fragments").withColumnsRenamed({"seq_bases": "sequence", "read_no": "read"})
    return fold_equal(f).where("n > 1").select(F.col("sequence").alias("seq_bases"), "quality", "tile", "xpos", "ypos", "index_sequence", "n")


def fragments_qc_filter(spark, folder):
    from helica.functions.names import passes_qc

    return table(spark, folder, "fragments").where(passes_qc(F.col("filter_passed"))).select("fragment_id", "filter_passed")


SHOWN = ["read_name", "flags", "ref_index", "contig", "start", "mapq", "cigar", "mate_contig", "mate_start", "insert_size", "bases", "quals", "tags"]


def sam_roundtrip(spark, folder):
    at = _file(spark, "reads.sam")
    write_reads(reads_of(spark, folder), at, HEADER)
    return read_sam(spark, at).select(*SHOWN)


def sam_stringency(spark, folder):
    """Lines of which some are broken, read without them."""
    lines = format_sam(reads_of(spark, folder)).select(F.regexp_replace("value", r"\tchr[13]\t\d+\t", "\tchr1\tx\t").alias("value"))
    return parse_sam(lines, HEADER, mode="SILENT").select("read_name", "contig", "start")


def cram_roundtrip(spark, folder):
    """Through parts without header and one merged file."""
    parts, header = _file(spark, "parts.cram"), header_of(spark, folder)
    write_reads(reads_of(spark, folder, header), parts, header, write_header=False)
    return read_cram(spark, merge_reads(parts, parts.replace("parts", "all"), header, "cram"), split_size=1 << 18).select(*SHOWN)


def cram_intervals(spark, folder):
    at, header = _file(spark, "reads.cram"), header_of(spark, folder)
    write_reads(sort_by_coordinate(with_read_key(reads_of(spark, folder, header))), at, header)
    return read_cram(spark, at, parse_intervals(INTERVALS)).select("read_name", "contig", "start")


def reads_of_mixed_formats(spark, folder):
    """A third of the reads in each format, in one folder."""
    at, header = _file(spark, "mixed"), header_of(spark, folder)
    os.makedirs(at)
    rows = reads_of(spark, folder, header).withColumn("_part", F.pmod(F.xxhash64("read_name"), F.lit(3)))
    for i, kind in enumerate(("bam", "sam", "cram")):
        part = f"{at}-{kind}"
        write_reads(rows.where(F.col("_part") == i), part, header, kind)
        for name in os.listdir(part):
            if name.startswith("part-"):
                os.rename(os.path.join(part, name), os.path.join(at, f"{name.removesuffix('.txt').removesuffix('.' + kind)}.{kind}"))
    return load_reads(spark, at).select("read_name", "contig", "start", F.when(F.col("contig").isNotNull() & (F.col("flags").bitwiseAND(F.lit(4)) == 0), F.col("key")).alias("placed_key"))


def _bam(spark: SparkSession, folder: str, **options) -> str:
    register_sources(spark)
    at, header = os.path.join(work_folder(spark), "reads.bam"), header_of(spark, folder)
    write_reads(reads_of(spark, folder, header), at, header, **options)
    return at


def bam_roundtrip(spark, folder):
    return read_bam(spark, _bam(spark, folder), splitSize=1 << 20).select(*SHOWN)


def bam_intervals(spark, folder):
    return read_bam(spark, _bam(spark, folder), parse_intervals(INTERVALS)).select("read_name", "contig", "start")


def bam_unplaced(spark, folder):
    return read_bam(spark, _bam(spark, folder), None, True).select("read_name", "flags")


def bam_merge(spark, folder):
    parts = _bam(spark, folder, write_header=False, splitting_index=True, granularity=64)
    merged = merge_reads(parts, parts.replace("reads.bam", "merged.bam"), header_of(spark, folder))
    return load_reads(spark, merged).select("read_name", "contig", "start")


def read_coordinate_key(spark, folder):
    a = table(spark, folder, "alignments").where("contig is not null and start_pos is not null")
    return a.select("read_id", coordinate_key(F.col("ref_index"), F.col("start_pos")).alias("key"))


def read_unmapped_key(spark, folder):
    """Hashed keys of the reads without a position, as they come with the file."""
    return load_reads(spark, _bam(spark, folder)).where("contig is null").select("read_name", "key")


def read_unmapped_key_of_rows(spark, folder):
    """The same from columns."""
    return with_read_key(reads_of(spark, folder)).where("contig is null").select("read_name", "key")


def _many_intervals() -> list[Interval]:
    return [Interval(f"chr{1 + i % 22}", 700_000 * i + 1, 700_000 * i + 5_000_000) for i in range(200)]


def read_many_intervals(spark, folder):
    """More intervals than a predicate takes, over reads of which some are equal and some wide."""
    wide = reads_of(spark, folder).withColumn("end", F.col("end") + F.when(F.col("start") % 7 == 0, 60_000).otherwise(0))
    twice = wide.unionAll(wide.where(F.col("start") % 5 == 0))
    return filter_by_intervals(twice, _many_intervals()).select("read_name", "contig", "start")


def vcf_many_intervals(spark, folder):
    rows = filter_by_intervals(variants_of(spark, folder), _many_intervals())
    return rows.select("id", "contig", "start", F.map_keys("attributes")[0].alias("first_key"))


def read_intervals(spark, folder):
    return select_reads(reads_of(spark, folder), parse_intervals(INTERVALS)).select("read_name", "contig", "start", "end")


def read_intervals_or_unplaced(spark, folder):
    return select_reads(reads_of(spark, folder), parse_intervals(INTERVALS), unplaced=True).select("read_name", "contig", "start", "end")


def read_interval_join(spark, folder):
    """Reads within 20000 positions of any variant of the same contig, as a join of two tables."""
    v = table(spark, folder, "variant_rows").where("contig is not null and pos is not null").select(F.col("contig").alias("_contig"), (F.col("pos") - 20000).cast("long").alias("_start"), (F.col("pos") + 20000).cast("long").alias("_stop"))
    reads = table(spark, folder, "alignments").where("contig is not null and start_pos is not null and end_pos is not null").select("read_id", "contig", "start_pos", "end_pos", "loaded_at")
    return interval_semi_join(reads, v, "contig", "start_pos", "end_pos").select("read_id", "contig", "start_pos")


def read_cigar_span(spark, folder):
    a = table(spark, folder, "alignments")
    steps = F.transform(cigar_steps(F.col("cigar")), lambda s: F.concat(s["op"], s["len"]))
    return a.select("read_id", reference_span(F.col("cigar")).alias("span"), F.array_join(steps, "").alias("steps"))


def read_tags(spark, folder):
    a = table(spark, folder, "alignments")
    return a.select("read_id", F.explode(tag_structs(F.col("opt_tags"))).alias("t")).select("read_id", "t.tag", "t.type", "t.value")


def read_sort_order(spark, folder):
    """Reads by their key over all partitions: how many, and how many of them lie before the one in front, within a part or at its start."""
    reads = sort_by_coordinate(with_read_key(reads_of(spark, folder))).select("key")

    def steps(batches):
        first = last = None
        n = wrong = 0
        for batch in batches:
            k = batch["key"].to_numpy()
            if not len(k):
                continue
            wrong += int((k[1:] < k[:-1]).sum()) + int(last is not None and k[0] < last)
            first, last, n = k[0] if first is None else first, k[-1], n + len(k)
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "n": [n], "wrong": [wrong]})

    parts = reads.mapInPandas(steps, "part int, first long, last long, n long, wrong long")
    before = F.lag("last").over(Window.orderBy("part"))
    return parts.withColumn("wrong", F.col("wrong") + F.coalesce((F.col("first") < before).cast("long"), F.lit(0))).agg(F.sum("n").alias("n"), F.sum("wrong").alias("n_wrong"))


def shuffle_by_name(spark, folder):
    """Reads of a name next to each other: how many there are of each."""
    grouped = group_by_read_name(table(spark, folder, "alignments"))
    return grouped.groupBy("read_name").agg(F.count(F.lit(1)).alias("n_reads"), F.min("start_pos").alias("first_start"))


def shuffle_by_variant(spark, folder):
    grouped = group_by_variant(variants_of(spark, folder))
    return grouped.groupBy("contig", "id").agg(F.count(F.lit(1)).alias("n"))


def vcf_roundtrip(spark, folder):
    at = _file(spark, "variants.vcf")
    write_vcf(variants_of(spark, folder), at, VCF_HEADER, compression="none")
    return format_vcf(read_variants(spark, at))


def vcf_compressed(spark, folder):
    at = _file(spark, "variants.vcf")
    write_vcf(variants_of(spark, folder), at, VCF_HEADER, compression="gzip")
    return format_vcf(read_variants(spark, at))


def vcf_fields(spark, folder):
    v = variants_of(spark, folder)
    return v.select("contig", "start", "end", "id", F.array_join("alleles", "/").alias("alleles"), "qual", F.coalesce(F.array_join("filters", ";"), F.lit("none")).alias("filters"), F.col("attributes")["PR"][0].alias("pr"), F.col("attributes")["DP"][0].cast("long").alias("dp"), F.map_contains_key("attributes", "DB").alias("db"), "n_genotypes")


def vcf_key(spark, folder):
    return variants_of(spark, folder).select("id", "key")


def vcf_intervals(spark, folder):
    return filter_by_intervals(variants_of(spark, folder), parse_intervals("chr1:1-50000000,chr2:100-90000000,chr1:40000000-200000000")).select("id", "contig", "start")


def vcf_genotypes(spark, folder):
    g = genotypes(variants_of(spark, folder), VCF_HEADER)
    return g.select("id", F.explode("genotypes").alias("g")).select("id", F.col("g.sample").alias("sample"), F.col("g.fields")["GT"].alias("gt"), F.col("g.fields")["GQ"].alias("gq"))


def vcf_stringency(spark, folder):
    """Lines of which some are broken, read without them."""
    lines = variant_lines_of(spark, folder).select(F.regexp_replace("value", r"^(chr[13])\t\d+", "$1\tx").alias("value"))
    return parse_vcf(lines, VCF_HEADER, mode="DROPMALFORMED").select("contig", "start", "id")


def vcf_bgzf_file(spark, folder):
    at = _file(spark, "parts")
    write_vcf(variants_of(spark, folder), at, VCF_HEADER, write_header=False)
    merged = merge_variants(at, at.replace("parts", "all.vcf.bgz"), VCF_TOP)
    return format_vcf(read_variants(spark, merged))


def bcf_roundtrip(spark, folder):
    at = _file(spark, "variants.bcf")
    variant_lines_of(spark, folder).write.format("bcf").mode("append").option("header", VCF_TOP).save(at)
    return format_vcf(read_variants(spark, at, split_size=1 << 18))


def fasta_positions(spark, folder):
    """One sequence for each 500 parts; its bases are the numbers of the parts in letters, 80 bytes a line."""
    at = _file(spark, "parts")
    p = table(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(F.lpad(F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACGTNACGTN"), 8, "A"))), "").alias("s"))
    p.select(F.concat(F.lit(">seq"), F.col("g"), F.lit("\n"), F.regexp_replace("s", "(.{80})(?=.)", "$1\n")).alias("value")).write.text(at)
    # The source reads one file: the parts are joined byte by byte, as whole sequences may follow each other in any order.
    one = at.replace("parts", "all.fasta")
    with open(one, "wb") as out:
        for part in part_files(at):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)
    return read_fasta(spark, one, 4096)


def virtual_offset(spark, folder):
    o = table(spark, folder, "bam_offsets")
    v = F.col("virtual_offset")
    return o.select("virtual_offset", offsets.block_of(v).alias("block"), offsets.inside_of(v).alias("inside"), offsets.shifted(v, F.lit(1000)).alias("shifted"), offsets.split_length(v, v + 70000).alias("length"))


def split_index(spark, folder):
    """The offsets that a splitting index of each file holds: record 1 and every one whose number is a multiple of the granularity."""
    sizes = table(spark, folder, "bam_files").select("bam_id", "file_size", F.when(F.col("granularity") > 0, F.col("granularity")).otherwise(DEFAULT_GRANULARITY).alias("g"))
    r = keyed_join(table(spark, folder, "bam_offsets").select("bam_id", "virtual_offset"), sizes, ["bam_id"], "inner")
    r = r.where(F.col("virtual_offset") != F.shiftleft("file_size", 16)).select("bam_id", "virtual_offset", "g").distinct()
    # Files of any size are numbered chunk by chunk of their bytes.
    n = running_start(r.withColumn("chunk", F.shiftright("virtual_offset", 40)), ["bam_id"], "chunk", ["virtual_offset"], F.lit(1)).withColumn("n", F.col("start") + 1)
    return n.where((F.col("n") == 1) | (F.col("n") % F.col("g") == 0)).select("bam_id", "virtual_offset")


def _sorted_bam(spark: SparkSession, folder: str, *order: str, **options) -> str:
    """One BAM file of all reads in an order, merged from parts."""
    parts, header = _file(spark, "parts.bam"), header_of(spark, folder)
    write_reads(reads_of(spark, folder, header).orderBy(*order), parts, header, write_header=False, **options)
    return merge_reads(parts, parts.replace("parts", "all"), header)


def _record_offsets(path: str) -> list[int]:
    header, begin = read_bam_header(path)
    return [o for _, _, some in record_slices(path, begin, size_of(path) << 16, bam_kind(header)) for o in some.tolist()]


def index_built(spark, folder):
    """The names of the reads that a splitting index points to, of a file in the order of names."""
    path = _sorted_bam(spark, folder, "read_name")
    data = build_splitting_index(path, 64)
    with open(path + ".splitting-bai", "wb") as out:
        out.write(data)
    index, names = SplittingIndex.read(path + ".splitting-bai"), []
    header, begin = read_bam_header(path)
    wanted = set(index.offsets[:-1])
    for data, at, offsets in record_slices(path, begin, size_of(path) << 16, bam_kind(header)):
        hit = np.isin(offsets, list(wanted))
        if hit.any():
            names += decode_records(data, at[hit], header, {"read_name"}).column(0).to_pylist()
    return _rows(spark, [(n,) for n in names], "read_name string")


def index_asked(spark, folder):
    """A splitting and a block index of one file against a plain search: how many answers there are, and how many are wrong."""
    path = _sorted_bam(spark, folder, "read_name", splitting_index=True, granularity=16)
    index, size = SplittingIndex.read(path + ".splitting-bai"), size_of(path)
    true, rows = set(_record_offsets(path)), []
    marks = index.offsets
    rows.append(("merged", len(marks) > 1, sum(o not in true for o in marks[:-1]) + (marks[-1] != size << 16) + sum(a >= b for a, b in zip(marks, marks[1:]))))
    places = [size * i // 50 for i in range(51)]
    rows.append(("records", True, sum(index.previous(p) != max((o for o in marks if o <= p << 16), default=None) or index.next(p) != min((o for o in marks if o > p << 16), default=None) for p in places)))
    with open(path + ".bgzfi", "wb") as out:
        out.write(build_block_index(path, 2))
    blocks, addresses = BlockIndex.read(path + ".bgzfi"), [a for a, _, _ in bgzf.block_addresses(path)]
    rows.append(("blocks", True, int(blocks.offsets != sorted({0, *addresses[1::2], size})) + sum(blocks.previous(p) != max(o for o in blocks.offsets if o <= p) or blocks.next(p) != min((o for o in blocks.offsets if o > p), default=None) for p in places)))
    return _rows(spark, rows, "index string, has_marks boolean, n_wrong long")


def starts_guessed(spark, folder):
    """Blocks and records looked for from addresses all over a file without an index: how many are none."""
    path = _sorted_bam(spark, folder, "read_name")
    size, true, (header, begin) = size_of(path), set(_record_offsets(path)), read_bam_header(path)
    blocks, kind = [a for a, _, _ in bgzf.block_addresses(path)], bam_kind(header)
    places = [size * i // 40 for i in range(40)]
    wrong_block = sum(bgzf.find_block(path, p, size) != min((a for a in blocks if a >= p), default=size) for p in places)
    found = [first_record(path, p, size, kind, begin) for p in places]
    ends = {size << 16}
    wrong_record = sum(o not in true and o not in ends for o in found)
    cut = BamReader({"path": path, "splitSize": str(max(size // 7, 1))}).partitions()
    apart = sum(a.end != b.start for a, b in zip(cut, cut[1:])) + (cut[0].start != 0) + (cut[-1].end != size << 16)
    ranges = [resolve(p, kind, begin) for p in cut]
    apart += sum(a[1] != b[0] for a, b in zip(ranges, ranges[1:]))
    return _rows(spark, [("blocks", wrong_block), ("records", wrong_record), ("ranges", apart)], "what string, n_wrong long")


def bai_ranges(spark, folder):
    """Reads of a sorted file by the ranges of its linear index."""
    return read_bam(spark, _coordinate_bam(spark, folder), baiSplits="true", splitSize=1 << 16).select("read_name", "contig", "start")


def _coordinate_bam(spark: SparkSession, folder: str) -> str:
    """One BAM file by coordinate, reads without a position at the end, with its ``.bai``."""
    parts, header = _file(spark, "parts.bam"), header_of(spark, folder).sorted_by("coordinate")
    c = F.col
    rows = reads_of(spark, folder, header).orderBy((c("ref_index") < 0).asc(), c("ref_index"), c("start"))
    write_reads(rows, parts, header, write_header=False)
    path = merge_reads(parts, parts.replace("parts", "all"), header)
    with open(path + ".bai", "wb") as out:
        out.write(build_bai(path))
    return path


def bai_intervals(spark, folder):
    """Reads on intervals, by the chunks of a linear index."""
    return read_bam(spark, _coordinate_bam(spark, folder), parse_intervals(INTERVALS), splitSize=1 << 16).select("read_name", "contig", "start")


def bam_key_ignored(spark, folder):
    """Reads written with their key, which is left out and made again."""
    at, header = _file(spark, "reads.bam"), header_of(spark, folder)
    write_reads(with_read_key(reads_of(spark, folder, header)).withColumn("key", F.lit(7).cast("long")), at, header)
    rows = load_reads(spark, at)
    return rows.where("contig is not null and flags % 8 < 4").select("read_name", "key")


def headers_read(spark, folder):
    """The contigs of the headers of every format, and what a VCF header defines."""
    rows = []
    for kind in ("sam", "bam", "cram"):
        at = _file(spark, f"reads.{kind}")
        write_reads(reads_of(spark, folder).limit(5).coalesce(1), at, HEADER)
        name = next(n for n in sorted(os.listdir(at)) if n.startswith("part-"))
        one = os.path.join(os.path.dirname(at), f"one.{kind}")
        os.rename(os.path.join(at, name), one)
        rows += [(kind, "contig", n, size) for n, size in read_sam_header(one).contigs]
    at = _file(spark, "x.bcf")
    variant_lines_of(spark, folder).limit(1).coalesce(1).write.format("bcf").mode("append").option("header", VCF_TOP).save(at)
    one = os.path.join(at, next(n for n in sorted(os.listdir(at)) if n.startswith("part-")))
    header = read_vcf_header(one)
    rows += [("bcf", "contig", n, size) for n, size in header.contigs] + [("bcf", kind, name, None) for kind, some in header.fields.items() for name in some] + [("bcf", "sample", n, None) for n in header.samples]
    found = parse_header(header_bytes(HEADER))
    rows += [("bytes", "contig", n, size) for n, size in found[0].contigs] + [("bytes", "length", "all", found[1])]
    return _rows(spark, rows, "source string, kind string, name string, length long")


def formats_found(spark, folder):
    """The format of files by name, by their first bytes, and as given; index files and hidden ones are no data."""
    at = _file(spark, "files")
    os.makedirs(at)
    contents = {"a.bam": bgzf.compress(b"x"), "b.sam": b"@HD", "c.cram": b"CRAM", "d": b"CRAM", "e.sam": bgzf.compress(b"x"), "f.vcf": b"##", "g.bcf": bgzf.compress(b"BCF"), "h.vcf.gz": bgzf.compress(b"##"), "i": bgzf.compress(b"BCF"), "a.bam.bai": b"", "a.bam.splitting-bai": b"", "h.vcf.gz.tbi": b"", "_SUCCESS": b"", ".x": b""}
    for name, data in contents.items():
        with open(os.path.join(at, name), "wb") as out:
            out.write(data)
    rows = []
    for path in expand(at):
        name = os.path.basename(path)
        rows.append((name, read_format(path) or "none", read_format(path, trust_names=False) or "none", variant_format(path) or "none", variant_format(path, trust_names=False) or "none", read_format(path, formats={path: "sam"})))
    return _rows(spark, rows, "name string, reads_by_name string, reads_by_data string, variants_by_name string, variants_by_data string, given string")


def refused(spark, folder):
    """What the operators refuse: each case and whether it was an error."""
    at = _file(spark, "x.bam")
    q = F.lit("I")
    cases = {
        "bounded traversal of nothing": lambda: check_traversal(None, False), "same encoding": lambda: convert_quality(q, "sanger", "sanger"), "unknown encoding": lambda: convert_quality(q, "sanger", "other"),
        "pairs together": lambda: BamReader({"path": at, "keepPairedReadsTogether": "true"}), "no header": lambda: write_reads(reads_of(spark, folder), at, None), "no format": lambda: write_reads(reads_of(spark, folder), at.replace(".bam", ""), HEADER),
        "format not given": lambda: read_format(at, formats={}), "no interval": lambda: parse_intervals("chr1:5"), "no boolean": lambda: parse_boolean("maybe", True), "genotypes without header": lambda: genotypes(variants_of(spark, folder), None),
        "unfinished parts": lambda: part_files(os.path.dirname(at)), "unsorted index": lambda: SplittingIndex([5, 3]),
    }
    rows = []
    for name, act in cases.items():
        try:
            act()
            rows.append((name, False))
        except (ValueError, FileNotFoundError):
            rows.append((name, True))
    return _rows(spark, rows, "what string, refused boolean")


def interval_texts(spark, folder):
    """Texts of intervals read and written again, and the joined ones."""
    text = "chr2:5-9,scaffold_7:1-1,a:b:3:10-20,chr2:8-30,chr2:31-40"
    parsed = parse_intervals(text)
    rows = [("read", *i) for i in parsed] + [("joined", *i) for i in merge_intervals(parsed)] + [("text", format_intervals(parsed), 0, 0), ("empty", str(len(parse_intervals(""))), 0, 0)]
    return _rows(spark, rows, "what string, contig string, start long, stop long")


def boolean_texts(spark, folder):
    words = ("yes", " True ", "T", "y", "1", "NO", "false", "f", "n", "0")
    return _rows(spark, [(w, parse_boolean(w, w in "n0")) for w in words] + [("default", parse_boolean(None, True))], "word string, value boolean")


def lines_of_text(spark, folder):
    """Lines of plain files with every kind of line end, read from ranges that start anywhere."""
    at = _file(spark, "lines")
    os.makedirs(at)
    p = table(spark, folder, "part").select("p_name", (F.col("p_partkey") % 3).alias("end"))
    for i, sep in enumerate(("\n", "\r\n", "\r")):
        part = f"{at}-{i}"
        p.where(F.col("end") == i).select("p_name").write.option("lineSep", sep).text(part)
        for n in os.listdir(part):
            if n.startswith("part-"):
                os.rename(os.path.join(part, n), os.path.join(at, f"{i}-{n}"))
    return spark.read.format("bgzf_lines").option("path", at).option("splitSize", 3000).load().select(F.col("value").alias("p_name"))


def parts_of_a_write(spark, folder):
    """The part files of a write in their order, and the reads of each kind of command line tool."""
    parts, header = _file(spark, "parts.bam"), header_of(spark, folder)
    write_reads(reads_of(spark, folder, header).repartition(4), parts, header, write_header=False, splitting_index=True)
    return _rows(spark, [(i, os.path.basename(p)) for i, p in enumerate(part_files(parts))], "place long, name string")


def tool_header(spark, folder):
    """The header that the command line prints, sorted by another order."""
    at = _sorted_bam(spark, folder, "read_name")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        tools_main(["header", at, "--sorted-by", "queryname"])
    return _rows(spark, [(i, line) for i, line in enumerate(said.getvalue().splitlines())], "n long, line string")


def hash_of_text(spark, folder):
    return table(spark, folder, "part").select("p_partkey", hash_text(F.col("p_name")).alias("h"))


def hash_of_bytes(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", hash_binary(F.col("c_custkey").cast("string").cast("binary")).alias("h"))


QUERIES = {
    f.__name__: f
    for f in (
        qseq_roundtrip, qseq_qc_filter, qseq_line_text, qseq_key_text, fastq_roundtrip, fastq_compressed, fastq_illumina_id, fastq_read_number, quality_illumina_to_sanger, quality_sanger_to_illumina, quality_verify, fragment_equality, fragments_qc_filter,
        sam_roundtrip, sam_stringency, bam_roundtrip, bam_intervals, bam_unplaced, bam_merge, bam_key_ignored, cram_roundtrip, cram_intervals, reads_of_mixed_formats, bai_ranges, bai_intervals,
        read_coordinate_key, read_unmapped_key, read_unmapped_key_of_rows, read_intervals, read_intervals_or_unplaced, read_many_intervals, read_interval_join, read_cigar_span, read_tags, read_sort_order, shuffle_by_name, shuffle_by_variant,
        vcf_roundtrip, vcf_compressed, vcf_fields, vcf_key, vcf_intervals, vcf_many_intervals, vcf_genotypes, vcf_stringency, vcf_bgzf_file, bcf_roundtrip, fasta_positions, virtual_offset,
        split_index, index_built, index_asked, starts_guessed, headers_read, formats_found, refused, interval_texts, boolean_texts, lines_of_text, parts_of_a_write, tool_header, hash_of_text, hash_of_bytes,
    )
}
