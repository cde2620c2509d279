import gzip

import pytest
from pyspark.sql import functions as F

from helica.sources.detect import read_format, read_format_of_data, read_format_of_name, variant_format, variant_format_of_name
from helica.sources.fragments import format_fastq, format_qseq, parse_qseq, read_fasta, read_fastq, read_qseq, write_fastq
from helica.sources.cram import container_splits
from helica.sources import bgzf

ILLUMINA = "M01:7:KXB9:3:12:640:9981 2:Y:4:GGTCA"
RECORDS = [
    ("plain name 77/2", "GATTACAN", "@+:;<=>?"),
    (ILLUMINA, "CCGTA", "FFFFF"),
    ("Q9:41::6:30:-12:-305 3:N:0:", "NACGTT", "HHHH@+"),
]


def write(path, records):
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    return str(path)


def test_fastq_ids(spark, tmp_path):
    a, b, c = read_fastq(spark, write(tmp_path / "x.fq", RECORDS)).collect()
    assert a.read == 2 and a.instrument is None and a.filter_passed is None
    assert (b.instrument, b.run_number, b.flowcell_id, b.lane, b.tile, b.xpos, b.ypos, b.read, b.filter_passed, b.control_number, b.index_sequence) == ("M01", 7, "KXB9", 3, 12, 640, 9981, 2, False, 4, "GGTCA")
    assert (c.flowcell_id, c.xpos, c.ypos, c.read, c.index_sequence, c.filter_passed) == ("", -12, -305, 3, "", True)


def test_names_of_almost_the_right_form(spark):
    from helica.functions.names import parse_run_id

    names = ["M01:7:K:3:12:640:9981 2:Y:4:A:B+C", "M01:7:K:3:12:640:9981\t 2:N:4:", ":7:K:3:12:640:9981 2:Y:4:A", "M01:-7:K:3:12:640:9981 2:Y:4:A", "M01:7:K:3:12:640 2:Y:4:A", "M01:7:K:3:12:640:9981 4:Y:4:A", "M01:7:K:3:12:640:9981 2:X:4:A", "M01:7:K:3:12:640:9981 2:Y:4", "M01:99999999999:K:3:12:640:9981 2:Y:4:A", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select(*(c.alias(n) for n, c in parse_run_id(F.col("name")).items())).collect()
    assert [r.index_sequence for r in rows] == ["A:B+C", ""] + [None] * 9
    assert [r.lane for r in rows] == [3, 3] + [None] * 9 and rows[1].filter_passed is True


def test_sticky_ids_stop_at_the_first_other_name(spark, tmp_path):
    path = write(tmp_path / "x.fq", [RECORDS[1], RECORDS[0], RECORDS[2]])
    rows = {r.key: r for r in read_fastq(spark, path, sticky=True).collect()}
    assert rows[ILLUMINA].lane == 3 and rows[RECORDS[0][0]].read == 2 and rows[RECORDS[2][0]].lane is None


def test_failed_reads_go_before_qualities_are_checked(spark, tmp_path):
    path = write(tmp_path / "x.fq", [(ILLUMINA, "AC", "I\x7f"), RECORDS[0]])
    assert read_fastq(spark, path, filter_failed_qc=True).count() == 1
    with pytest.raises(Exception, match="out of range"):
        read_fastq(spark, path).collect()


def test_illumina_qualities(spark, tmp_path):
    path = write(tmp_path / "x.fq", [("n", "ACG", "@h~")])
    assert read_fastq(spark, path, encoding="illumina").first().quality == "!I_"
    with pytest.raises(ValueError):
        read_fastq(spark, path, encoding="other")


@pytest.mark.parametrize("split", [7, 50, 333, 1 << 20])
def test_fastq_splits_have_every_record_once(spark, tmp_path, split):
    records = [(f"r{i}" if i % 3 else ILLUMINA + str(i), "ACGTA"[: 1 + i % 5] * (1 + i % 7), "") for i in range(300)]
    records = [(n, s, "@" + "+" * (len(s) - 1) if i % 2 else "I" * len(s)) for i, (n, s, _) in enumerate(records)]
    rows = read_fastq(spark, write(tmp_path / "x.fq", records), split_size=split).select("key", "sequence", "quality").collect()
    assert sorted(map(tuple, rows)) == sorted(records)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_lines_of_every_end(tmp_path, end):
    from helica.sources.files import sliced_lines

    lines = ["x" * (i * 7 % 23) for i in range(200)] + ["y" * 5000, "", "last"]
    text = end.join(lines)
    path = tmp_path / "x"
    path.write_bytes(text.encode())
    for step in (1, 3, 64, 10_000):
        for chunk in (1, 2, 7, 1 << 20) if step > 3 else (5,):
            got = [(a, x.decode()) for s in range(0, len(text), step) for a, x in sliced_lines(str(path), s, min(s + step, len(text)), chunk)]
            assert [x for _, x in got] == lines and all(text[a : a + len(x)] == x for a, x in got)


@pytest.mark.parametrize("end,blank", [("\n", ""), ("\r\n", ""), ("\r", ""), ("\n", "\n\n")])
def test_fastq_of_every_line_end(spark, tmp_path, end, blank):
    records = [(f"r{i} ä", "ACGT" * (1 + i % 9), "@+IJ" * (1 + i % 9)) for i in range(80)]
    text = "".join(f"@{n}{end}{s}{end}+{n}{end}{q}{end}{blank}" for n, s, q in records)
    (tmp_path / "x.fq").write_bytes(text.encode())
    for split in (100, 1 << 20):
        rows = read_fastq(spark, str(tmp_path / "x.fq"), split_size=split).select("key", "sequence", "quality").collect()
        assert sorted(map(tuple, rows)) == sorted(records)


def test_long_fastq_lines(spark, tmp_path):
    path = write(tmp_path / "x.fq", [("a", "ACGT" * 2_000_000, "IIII" * 2_000_000), ("b", "A", "I")])
    assert [len(r.sequence) for r in read_fastq(spark, path).collect()] == [8_000_000, 1]
    with pytest.raises(Exception, match="line of more"):
        spark.read.format("fastq").option("path", path).option("maxLine", 10_000).load().collect()


def test_compressed_fastq_and_broken_fastq(spark, tmp_path):
    (tmp_path / "x.fq.gz").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n"))
    assert read_fastq(spark, str(tmp_path / "x.fq.gz")).first().sequence == "AC"
    for text in ("@a\nAC\n-\nII\n", "@a\nAC\n", "a\nAC\n+\nII\n"):
        (tmp_path / "y.fq").write_text(text)
        with pytest.raises(Exception):
            read_fastq(spark, str(tmp_path / "y.fq")).collect()


def test_fastq_writing(spark, tmp_path):
    rows = read_fastq(spark, write(tmp_path / "x.fq", RECORDS))
    write_fastq(rows.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, read_fastq(spark, str(tmp_path / "out")).select("key", "sequence", "quality").collect())) == sorted(RECORDS)
    bare = spark.createDataFrame([("AC", "II")], "sequence string, quality string")
    assert format_fastq(bare).first().value == "@:::::: :N:0:\nAC\n+\nII"
    made = rows.where("lane = 3").drop("key").limit(1)
    assert format_fastq(made, "illumina").first().value.split("\n")[3] == "eeeee"


QSEQ = [
    "M01\t52\t3\t9\t-14\t803\t0\t2\t..ACCGTA\tBCDEFGHI\t0",
    "M01\t53\t3\t9\t15\t804\tGG.A\t1\tTTGA\tffff\t1",
]


def test_qseq_fields(spark):
    df = parse_qseq(spark.createDataFrame([(x,) for x in QSEQ], "value string"))
    a, b = df.collect()
    assert a.key == "M01:52:3:9:-14:803:2" and a.sequence == "NNACCGTA" and a.quality == "#$%&'()*"
    assert a.filter_passed is False and a.index_sequence is None and b.index_sequence == "GGNA" and b.filter_passed is True
    assert [r.value for r in format_qseq(df).collect()] == QSEQ
    assert format_qseq(df, "sanger").collect()[1].value.split("\t")[9] == "GGGG"


def test_qseq_filter_and_malformed(spark, tmp_path):
    (tmp_path / "x").write_text("\n".join([*QSEQ, "too\tfew"]) + "\n")
    assert read_qseq(spark, str(tmp_path / "x"), filter_failed_qc=True, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="malformed QSEQ"):
        read_qseq(spark, str(tmp_path / "x")).collect()


def test_fasta_positions(spark, tmp_path):
    text = ">one a long name\n" + "".join("GGATC" * 12 + "\n" for _ in range(4)) + ">two\n" + "CATG" * 15 + "\n"
    (tmp_path / "x.fa").write_text(text)
    for split in (10, 100, 1 << 20):
        rows = read_fasta(spark, str(tmp_path / "x.fa"), split).orderBy("index_sequence", "position").collect()
        assert [r.position for r in rows] == [1, 62, 123, 184, 1]
    assert rows[1].key == "one a long name62" and rows[4].sequence == "CATG" * 15
    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(text.encode()))
    assert read_fasta(spark, str(tmp_path / "x.fa.gz")).count() == 5


def test_formats_by_name_and_data(tmp_path):
    assert [read_format_of_name(f"x.{e}") for e in ("bam", "cram", "sam", "txt")] == ["bam", "cram", "sam", None]
    assert [variant_format_of_name(f"x.{e}") for e in ("bcf", "vcf", "gz", "bgz", "txt")] == ["bcf", "vcf", "vcf", "vcf", None]
    (tmp_path / "a.sam").write_bytes(bgzf.compress(b"x"))
    assert read_format(str(tmp_path / "a.sam")) == "sam" and read_format(str(tmp_path / "a.sam"), trust_names=False) == "bam"
    (tmp_path / "b").write_bytes(b"CRAM")
    assert read_format_of_data(str(tmp_path / "b")) == "cram"
    (tmp_path / "c.vcf").write_bytes(gzip.compress(b"BCF"))
    assert variant_format(str(tmp_path / "c.vcf"), trust_names=False) == "bcf"
    with pytest.raises(ValueError):
        variant_format("x.vcf", formats={"y.vcf": "vcf"})


def test_container_splits_of_a_known_layout():
    for size in (500, 900):
        assert container_splits([800, 2600], 2638, size) == [(800, 1800), (2600, 38)]
    assert container_splits([800, 2600], 2638, 5000) == [(800, 1838)]


def test_container_splits_cover_all():
    assert sum(n for _, n in container_splits([26, 1000, 5000], 9000, 700)) == 9000 - 26


def test_quality_functions(spark):
    from helica.functions.quality import convert_quality, first_bad_quality, illumina_to_sanger, sanger_to_illumina

    df = spark.createDataFrame([("@AZ",), ("bad\x1f",), (None,), ("",)], "q string")
    rows = df.select(illumina_to_sanger(F.col("q"), False).alias("a"), first_bad_quality(F.col("q")).alias("b")).collect()
    assert [r.a for r in rows] == ["!\";", None, None, ""] and [r.b for r in rows] == [-1, 3, None, -1]
    assert df.limit(1).select(sanger_to_illumina(F.lit("!I_"))).first()[0] == "@h~"
    with pytest.raises(Exception, match="out of range"):
        df.limit(1).select(sanger_to_illumina(F.lit("~"))).collect()
    for pair in (("sanger", "sanger"), ("x", "y")):
        with pytest.raises(ValueError):
            convert_quality(F.col("q"), *pair)
