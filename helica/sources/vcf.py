"""VCF text: headers, lines as typed variants, and variants as lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helica.functions.intervals import Interval, filter_by_intervals, format_intervals
from helica.functions.keys import variant_key
from helica.sources import bgzf
from helica.sources.detect import variant_format
from helica.sources.files import expand
from helica.sources.text_out import checked_mode, split_once, with_top_lines, without_malformed

COLUMNS = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


@dataclass
class VcfHeader:
    """Header text, contigs (name, length or None), definitions by class and id, and samples, each in its order."""

    text: str = ""
    contigs: list[tuple[str, int | None]] = field(default_factory=list)
    fields: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> VcfHeader:
        if not text.startswith("##fileformat=VCF"):
            raise ValueError("not a VCF header")
        header = cls(text)
        for line in text.splitlines():
            m = re.match(r"##(\w+)=<(.*)>\s*$", line)
            if m:
                parts = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2])}
                if m[1] == "contig" and "ID" in parts:
                    header.contigs.append((parts["ID"], int(parts["length"]) if parts.get("length", "").isdigit() else None))
                elif "ID" in parts:
                    header.fields.setdefault(m[1], {})[parts["ID"]] = parts
            elif line.startswith("#CHROM"):
                header.samples = line.split("\t")[9:]
        return header

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.contigs]


def read_vcf_header(path: str) -> VcfHeader:
    """The header of a VCF file (plain, gzip or BGZF) or a BCF file."""
    length = 1 << 16
    while True:
        data = bgzf.head_of(path, length)
        if data[:3] == b"BCF":
            from helica.sources.bcf import header_of

            found = header_of(data)
            if found:
                return found[0]
        elif not data.startswith(b"#"):
            raise ValueError(f"{path} is neither VCF nor BCF")
        else:
            m = re.search(rb"^#CHROM.*\n", data, re.M)
            if m:
                return VcfHeader.parse(data[: m.end()].decode())
        if len(data) < length:
            raise ValueError(f"{path} ends inside its header")
        length *= 4


def contig_index(names: list[str], contig: Column) -> Column:
    if not names:
        return F.lit(None).cast("int")
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), contig), F.lit(0)).cast("int") - 1


def info_map(info: Column) -> Column:
    """INFO as a map of arrays; a flag has an empty array, a repeated key its first values."""
    entries = F.transform(
        F.filter(F.split(info, ";"), lambda e: (e != "") & (e != ".")),
        lambda e: F.struct(F.split_part(e, F.lit("="), F.lit(1)).alias("key"), F.when(F.contains(e, F.lit("=")), F.split(F.substring(e, F.instr(e, "=") + 1, F.length(e)), ",")).otherwise(F.array().cast("array<string>")).alias("value")),
    )
    keys = F.transform(entries, lambda e: e["key"])
    unique = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(unique)


def attribute(header: VcfHeader, name: str) -> Column:
    """An INFO value typed as the header says: a flag as boolean, a field with Number 1 as one value, others as arrays; ``.`` is null."""
    known = header.fields.get("INFO", {}).get(name)
    if known is None:
        raise ValueError(f"{name} is not in the header")
    if known.get("Type") == "Flag" or known.get("Number") == "0":
        return F.coalesce(F.map_contains_key("attributes", name), F.lit(False))
    kind = {"Integer": "int", "Float": "double"}.get(known.get("Type", ""), "string")
    values = F.try_element_at("attributes", F.lit(name))
    typed = lambda v: F.when(v != ".", v).cast(kind)
    return typed(F.get(values, F.lit(0))) if known.get("Number") == "1" else F.transform(values, typed)


def parse_vcf(lines: DataFrame, header: VcfHeader, column: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Variants from lines of VCF text; lines with ``#`` and empty ones are left out.

    ``filters`` is null where none were applied, empty for PASS, else the names.
    ``end`` is INFO/END or the last base of REF. Genotypes stay one text, with
    their FORMAT, until they are asked for. A malformed line (fewer than 8 fields, a
    position or quality that is no number, alleles that are none, blanks in INFO, a
    wrong number of samples) is an error, or left out with ``DROPMALFORMED``.
    """
    mode = checked_mode(mode)
    body = split_once(lines.where((F.length(column) > 0) & ~F.col(column).startswith("#")), column)
    at = lambda i: F.get("_f", F.lit(i))
    allele = r"^([ACGTNacgtnRYSWKMBDHVryswkmbdhv]+|\*|<[^<>\s]+>|\.|[^\s,]*[\[\]][^\s,]*)\z"
    bad = (
        (F.size("_f") < 8) | at(1).try_cast("int").isNull() | ((at(5) != ".") & at(5).try_cast("double").isNull()) | ~at(3).rlike(r"^[A-Za-z]+\z")
        | F.exists(F.split(at(4), ","), lambda a: ~a.rlike(allele)) | at(7).rlike(r"\s|^=|;=")
        | ((F.size("_f") > 8) & (F.size("_f") - 9 != len(header.samples)) if header.samples else F.lit(False))
    )
    body = without_malformed(body, F.coalesce(bad, F.lit(True)), mode, "VCF")
    pos = at(1).cast("int")
    ends = F.nullif(F.regexp_extract(at(7), r"(?:^|;)END=(\d+)", 1), F.lit("")).cast("int")
    qual = F.when(at(5) != ".", at(5).cast("double"))
    alts = F.when(at(4) == ".", F.array().cast("array<string>")).otherwise(F.split(at(4), ","))
    filters = F.when(at(6) == ".", F.lit(None)).when(at(6) == "PASS", F.array().cast("array<string>")).otherwise(F.split(at(6), ";"))
    return body.select(
        variant_key(contig_index(header.names, at(0)), at(0), pos).alias("key"), at(0).alias("contig"), pos.alias("start"), F.coalesce(ends, pos + F.length(at(3)) - 1).alias("end"),
        F.when(at(2) != ".", at(2)).alias("id"), F.concat(F.array(at(3)), alts).alias("alleles"), qual.alias("qual"), (qual / -10).alias("log10_p_error"), filters.alias("filters"),
        info_map(at(7)).alias("attributes"), at(7).alias("info_raw"), F.greatest(F.size("_f") - 9, F.lit(0)).alias("n_genotypes"), at(8).alias("format"),
        F.when(F.size("_f") > 9, F.array_join(F.slice("_f", 10, F.size("_f")), "\t")).alias("genotypes_raw"),
    )


def genotypes(variants: DataFrame, header: VcfHeader | None) -> DataFrame:
    """Add ``genotypes``: (sample, fields) for each sample. Needs the header, which has the samples' names."""
    if header is None:
        raise ValueError("genotypes need the header")
    samples = F.array(*map(F.lit, header.samples)) if header.samples else F.array().cast("array<string>")
    names = F.split("format", ":")
    cells = F.arrays_zip(samples.alias("sample"), F.split("genotypes_raw", "\t").alias("cell"))
    values = lambda cell: F.map_from_entries(F.filter(F.arrays_zip(names.alias("key"), F.split(cell, ":").alias("value")), lambda e: e["key"].isNotNull()))
    return variants.withColumn("genotypes", F.when(F.col("genotypes_raw").isNotNull(), F.transform(cells, lambda c: F.struct(c["sample"].alias("sample"), values(c["cell"]).alias("fields")))))


def _quality(q: Column) -> Column:
    whole = q == F.floor(q)
    return F.when(q.isNull(), ".").when(whole, q.cast("long").cast("string")).otherwise(q.cast("string"))


def format_vcf(variants: DataFrame, column: str = "value") -> DataFrame:
    """Variants as lines of VCF text; the key is left out. INFO comes from ``info_raw``."""
    dot = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    filters = F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";"))
    alts = dot(F.array_join(F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(0))), ","))
    return variants.select(
        F.concat_ws("\t", F.col("contig"), F.col("start").cast("string"), dot(F.col("id")), F.col("alleles")[0], alts, _quality(F.col("qual")), filters, dot(F.col("info_raw")), F.when(F.col("genotypes_raw").isNotNull(), F.concat_ws("\t", "format", "genotypes_raw"))).alias(column)
    )


def variant_lines(spark: SparkSession, files: list[str], kind: str, intervals: list[Interval] | None = None, split_size: int | None = None) -> DataFrame:
    """Lines of VCF files of one kind: ``plain`` and ``gzip`` by the text source, ``bgzf`` split by blocks, ``bcf`` decoded to text."""
    if kind == "bgzf":
        source = spark.read.format("bgzf_lines").option("path", ",".join(files))
        source = source.option("intervals", format_intervals(intervals)) if intervals else source
        return (source.option("splitSize", split_size) if split_size else source).load().select("value")
    if kind == "bcf":
        source = spark.read.format("bcf").option("path", ",".join(files))
        return (source.option("splitSize", split_size) if split_size else source).load()
    return spark.read.text(files)


def _kind(path: str, trust_names: bool, formats: dict[str, str] | None) -> str:
    found = variant_format(path, trust_names, formats)
    if found is None:
        raise ValueError(f"{path} is neither VCF nor BCF")
    if found == "bcf":
        return "bcf"
    kind = bgzf.sniff(path) if path.endswith((".gz", ".bgz", ".bgzf")) or not trust_names else "plain"
    if kind == "gzip" and not path.endswith(".gz"):
        raise ValueError(f"{path} is gzip without the name of one")
    return kind


def read_variants(
    spark: SparkSession,
    path: str,
    mode: str = "FAILFAST",
    intervals: list[Interval] | None = None,
    trust_names: bool = True,
    formats: dict[str, str] | None = None,
    header: VcfHeader | None = None,
    split_size: int | None = None,
) -> DataFrame:
    """The variants of VCF and BCF files of one header, in any mix of plain text, gzip and BGZF.

    Rows that do not overlap an interval are left out; an empty list leaves none. A
    ``.tbi`` beside a block gzip file saves reading ranges without such rows.
    """
    files = expand(path)
    head = header or read_vcf_header(files[0])
    by_kind: dict[str, list[str]] = {}
    for f in files:
        by_kind.setdefault(_kind(f, trust_names, formats), []).append(f)
    lines, rows = None, None
    for kind, some in sorted(by_kind.items()):
        if kind == "bcf":  # typed as it is, so no text is made of it
            rows = _typed_variants(spark, some, head, split_size)
            continue
        part = variant_lines(spark, some, kind, intervals, split_size)
        lines = part if lines is None else lines.unionByName(part)
    if lines is not None:
        parsed = parse_vcf(lines, head, mode=mode)
        rows = parsed if rows is None else rows.unionByName(parsed)
    return filter_by_intervals(rows, intervals)


def _typed_variants(spark: SparkSession, files: list[str], header: VcfHeader, split_size: int | None) -> DataFrame:
    """The variants of BCF files, with the columns of parsed lines."""
    source = spark.read.format("bcf").option("path", ",".join(files)).option("typed", "true")
    rows = (source.option("splitSize", split_size) if split_size else source).load()
    key = variant_key(contig_index(header.names, F.col("contig")), F.col("contig"), F.col("start"))
    at = rows.columns.index("qual") + 1
    return rows.select(key.alias("key"), *rows.columns[:at], (F.col("qual") / -10).alias("log10_p_error"), *rows.columns[at:])


def write_vcf(variants: DataFrame, path: str, header: VcfHeader, write_header: bool = True, compression: str = "bgzf", mode: str = "errorifexists") -> None:
    """One file a partition: ``bgzf`` (no terminator, so that parts can be merged), ``gzip`` or ``none``."""
    lines = format_vcf(variants)
    if compression == "bgzf":
        writer = lines.write.format("bgzf_lines").mode("overwrite" if mode == "overwrite" else "append")
        writer.option("header", header.text if write_header else "").option("suffix", ".vcf.bgz").save(path)
        return
    if compression not in ("gzip", "none"):
        raise ValueError(f"unknown compression {compression}")
    if write_header:
        lines = with_top_lines(lines, header.text.splitlines())
    lines.write.mode(mode).option("compression", compression).text(path)
