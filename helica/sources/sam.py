"""SAM text: headers, lines as typed reads, and reads as lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helica.functions.intervals import Interval, filter_by_intervals
from helica.functions.keys import read_key
from helica.sources.files import expand, open_file
from helica.sources.text_out import checked_mode, split_once, with_top_lines, without_malformed

#: The columns of reads, whatever format they come from.
READ_COLUMNS = ("read_name", "flags", "ref_index", "contig", "start", "end", "mapq", "cigar", "mate_ref_index", "mate_contig", "mate_start", "insert_size", "bases", "quals", "tags")
READ_SCHEMA = "read_name string, flags int, ref_index int, contig string, start int, end int, mapq int, cigar string, mate_ref_index int, mate_contig string, mate_start int, insert_size int, bases string, quals string, tags string"
SAM_TEXT = ("read_name", "flags", "contig", "start", "mapq", "cigar", "mate_contig", "mate_start", "insert_size", "bases", "quals")


@dataclass
class SamHeader:
    """Header text and the reference sequences (name, length) in their order."""

    text: str = ""
    contigs: list[tuple[str, int]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> SamHeader:
        contigs = []
        for line in text.splitlines():
            if line.startswith("@SQ"):
                tags = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
                if "SN" not in tags or not tags.get("LN", "").isdigit():
                    raise ValueError(f"bad sequence line: {line}")
                contigs.append((tags["SN"], int(tags["LN"])))
        return cls(text, contigs)

    @classmethod
    def of_contigs(cls, contigs: list[tuple[str, int]], sort_order: str = "unsorted") -> SamHeader:
        lines = [f"@HD\tVN:1.6\tSO:{sort_order}", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs)]
        return cls("\n".join(lines) + "\n", list(contigs))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.contigs]

    def sorted_by(self, order: str) -> SamHeader:
        """The header with another sort order (``coordinate``, ``queryname``, ...)."""
        lines = self.text.splitlines()
        if lines and lines[0].startswith("@HD"):
            parts = [p for p in lines[0].split("\t") if not p.startswith(("SO:", "GO:"))]
            lines[0] = "\t".join([*parts, f"SO:{order}"])
        else:
            lines.insert(0, f"@HD\tVN:1.6\tSO:{order}")
        return SamHeader("\n".join(lines) + "\n", list(self.contigs))


def read_text_header(path: str) -> SamHeader:
    """The lines with ``@`` at the start of a SAM file; a file without any has an empty header."""
    lines = []
    with open_file(path) as f:
        rest = b""
        while chunk := f.read(1 << 16):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if not line.startswith(b"@"):
                    return SamHeader.parse("".join(lines))
                lines.append(line.decode().removesuffix("\r") + "\n")
        if rest.startswith(b"@"):
            lines.append(rest.decode() + "\n")
    return SamHeader.parse("".join(lines))


def reference_span(cigar: Column) -> Column:
    """Reference positions that a CIGAR covers; 0 for ``*`` and null."""
    steps = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0))


def cigar_steps(cigar: Column) -> Column:
    """A CIGAR as an array of (len, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda s: F.struct(F.regexp_extract(s, r"^(\d+)", 1).cast("int").alias("len"), F.right(s, F.lit(1)).alias("op")))


def tag_structs(tags: Column) -> Column:
    """Optional fields as an array of (tag, type, value), in their order."""
    return F.transform(F.filter(F.split(tags, "\t"), lambda t: t != ""), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), F.substring(t, F.lit(6), F.length(t)).alias("value")))


def index_of(contigs: list[str], name: Column) -> Column:
    """The place of a contig in the header, -1 if it is null or not in it."""
    if not contigs:
        return F.lit(-1)
    return F.coalesce(F.array_position(F.array(*map(F.lit, contigs)), name).cast("int") - 1, F.lit(-1))


def parse_sam(lines: DataFrame, header: SamHeader, column: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Reads from lines of SAM text; header and empty lines are left out.

    ``*`` is null in names of contigs, ``=`` the read's own contig. A line with
    fewer than 11 fields or numbers that do not parse is an error, or left out
    with ``mode="DROPMALFORMED"``. ``end`` is the last position covered, the start
    where nothing is.
    """
    mode = checked_mode(mode)
    body = split_once(lines.where((F.length(column) > 0) & ~F.col(column).startswith("@")), column)
    at = lambda i: F.get("_f", F.lit(i))
    numbers = F.array(*(at(i).try_cast("int") for i in (1, 3, 4, 7, 8)))
    bad = (F.size("_f") < 11) | F.exists(numbers, lambda n: n.isNull())
    body = without_malformed(body, F.coalesce(bad, F.lit(True)), mode, "SAM")
    contig = F.when(at(2) != "*", at(2))
    mate = F.when(at(6) == "=", contig).when(at(6) != "*", at(6))
    start = at(3).cast("int")
    return body.select(
        at(0).alias("read_name"), at(1).cast("int").alias("flags"), index_of(header.names, contig).alias("ref_index"), contig.alias("contig"), start.alias("start"),
        (start + F.greatest(reference_span(at(5)) - 1, F.lit(0))).alias("end"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        index_of(header.names, mate).alias("mate_ref_index"), mate.alias("mate_contig"), at(7).cast("int").alias("mate_start"), at(8).cast("int").alias("insert_size"),
        at(9).alias("bases"), at(10).alias("quals"), F.array_join(F.slice("_f", 12, F.greatest(F.size("_f") - 11, F.lit(0))), "\t").alias("tags"),
    )


def format_sam(reads: DataFrame, column: str = "value") -> DataFrame:
    """Reads as lines of SAM text; the key column, if any, is left out. A mate on the read's own contig is ``=``."""
    star = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    mate = F.when(F.col("mate_contig").isNull(), "*").when(F.col("mate_contig") == F.col("contig"), "=").otherwise(F.col("mate_contig"))
    defaults = {"read_name": "*", "flags": "0", "contig": "*", "start": "0", "mapq": "255", "cigar": "*", "mate_start": "0", "insert_size": "0", "bases": "*", "quals": "*"}
    parts = [mate if c == "mate_contig" else star(c, defaults[c]) for c in SAM_TEXT]
    return reads.select(F.concat_ws("\t", *parts, F.when(F.coalesce(F.col("tags"), F.lit("")) != "", F.col("tags"))).alias(column))


def with_read_key(reads: DataFrame) -> DataFrame:
    """Add the sortable ``key``."""
    c = F.col
    return reads.withColumn("key", read_key(c("flags"), c("ref_index"), c("start"), c("read_name"), c("bases"), c("quals"), c("cigar")))


def select_reads(reads: DataFrame, intervals: list[Interval] | None, unplaced: bool = False, contigs: list[str] | None = None) -> DataFrame:
    """Reads that overlap an interval, and with ``unplaced`` those without a position.

    Without intervals: all reads, or with ``unplaced`` only those without a
    position. An interval on a contig that ``contigs`` does not have is an error.
    """
    if intervals is None:
        return reads.where(F.col("contig").isNull()) if unplaced else reads
    missing = {i.contig for i in intervals} - set(contigs) if contigs is not None else set()
    if missing:
        raise ValueError(f"contigs are not in the header: {sorted(missing)}")
    return filter_by_intervals(reads, intervals, unplaced=unplaced)


def check_traversal(intervals, unplaced: bool, bounded: bool = True) -> None:
    """A bounded traversal without intervals and without unplaced reads selects nothing and is an error."""
    if bounded and intervals is None and not unplaced:
        raise ValueError("a traversal needs intervals, unplaced reads, or both")


def headers_of(paths: list[str]) -> dict[str, list[str]]:
    """SAM files by the text of their header; read side by side, so that many files do not wait for each other."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(16) as pool:
        texts = list(pool.map(lambda p: read_text_header(p).text, paths))
    found: dict[str, list[str]] = {}
    for path, text in zip(paths, texts):
        found.setdefault(text, []).append(path)
    return found


def read_sam(spark: SparkSession, path: str, header: SamHeader | None = None, mode: str = "FAILFAST", intervals: list[Interval] | None = None, unplaced: bool = False) -> DataFrame:
    """The reads of SAM files that share a header (that of the first file unless given)."""
    files = expand(path)
    head = header or read_text_header(files[0])
    reads = parse_sam(spark.read.text(files), head, mode=mode)
    return select_reads(reads, intervals, unplaced, head.names if intervals and head.names else None)


def write_sam(reads: DataFrame, path: str, header: SamHeader, write_header: bool = True, mode: str = "errorifexists") -> None:
    """One text file a partition, each with the header unless ``write_header`` is false."""
    lines = format_sam(reads)
    if write_header:
        lines = with_top_lines(lines, header.text.splitlines())
    lines.write.mode(mode).text(path)
