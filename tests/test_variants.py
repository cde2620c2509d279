import gzip

import pytest

from helica.functions.intervals import parse_intervals
from helica.sources import bgzf
from helica.sources.bcf import Dictionary, decode_record, encode_line
from helica.sources.merge import merge_variants
from helica.sources.vcf import VcfHeader, format_vcf, genotypes, parse_vcf, read_variants, read_vcf_header, write_vcf

TOP = """##fileformat=VCFv4.2
##contig=<ID=ctgA,length=9000000>
##contig=<ID=ctgB>
##INFO=<ID=HITS,Number=1,Type=Integer,Description="Reads, all of them">
##INFO=<ID=SHARE,Number=A,Type=Float,Description="Share of each allele">
##INFO=<ID=LAB,Number=1,Type=String,Description="Where it was seen">
##INFO=<ID=OLD,Number=0,Type=Flag,Description="Seen before">
##INFO=<ID=END,Number=1,Type=Integer,Description="Last position">
##FILTER=<ID=weak,Description="Too few reads">
##FILTER=<ID=edge,Description="At the end of a contig">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Alleles">
##FORMAT=<ID=SC,Number=1,Type=Integer,Description="Score">
##FORMAT=<ID=PR,Number=2,Type=Integer,Description="Pair of counts">
##FORMAT=<ID=LK,Number=G,Type=Float,Description="Likelihoods">
##FORMAT=<ID=ST,Number=1,Type=String,Description="State">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tfox\towl
"""
LINES = [
    "ctgA\t801\tv7\tC\tT\t31\tPASS\tHITS=9;SHARE=0.125;OLD\tGT:SC:PR\t1/0:7:4,5\t0|0:12:.,.",
    "ctgA\t5602\t.\tGA\tG\t8\tweak;edge\tHITS=2;LAB=north\tGT:SC\t./.:.\t1|1:6",
    "ctgA\t77003\tv9\tT\tA,TCC\t12.5\tPASS\tSHARE=0.5,0.25\tGT:LK:ST\t2|1:-0.5,0,-8:good\t0:4,5,6:unsure",
    "ctgB\t64\t.\tC\t.\t90\t.\tHITS=1;END=95\tGT\t0/0\t0|0",
    "ctgB\t300\t.\tACGT\t<DUP>\t.\tPASS\t.\tGT\t1/1\t0/1",
]
HEADER = VcfHeader.parse(TOP)


def frame(spark, lines=LINES):
    return spark.createDataFrame([(x,) for x in TOP.splitlines() + list(lines)], "value string")


def test_header():
    assert HEADER.contigs == [("ctgA", 9000000), ("ctgB", None)]
    assert HEADER.samples == ["fox", "owl"] and HEADER.fields["INFO"]["HITS"]["Description"] == "Reads, all of them"
    with pytest.raises(ValueError):
        VcfHeader.parse("no header")


def test_fields(spark):
    a, b, c, d, e = parse_vcf(frame(spark), HEADER).collect()
    assert (a.contig, a.start, a.end, a.id, a.alleles, a.qual) == ("ctgA", 801, 801, "v7", ["C", "T"], 31.0)
    assert a.log10_p_error == -3.1 and a.filters == [] and b.filters == ["weak", "edge"] and d.filters is None
    assert a.attributes == {"HITS": ["9"], "SHARE": ["0.125"], "OLD": []} and e.attributes == {}
    assert b.end == 5603 and d.end == 95 and e.end == 303 and d.alleles == ["C"] and e.qual is None and e.log10_p_error is None
    assert a.key == 800 and d.key == (1 << 32) | 63 and a.n_genotypes == 2


def test_lines_come_back(spark):
    assert [r.value for r in format_vcf(parse_vcf(frame(spark), HEADER)).collect()] == LINES


def test_genotypes_need_the_header(spark):
    rows = genotypes(parse_vcf(frame(spark), HEADER), HEADER).collect()
    assert rows[0].genotypes[0].asDict(True) == {"sample": "fox", "fields": {"GT": "1/0", "SC": "7", "PR": "4,5"}}
    with pytest.raises(ValueError):
        genotypes(parse_vcf(frame(spark), HEADER), None)


def test_malformed_rows(spark):
    bad = ["ctgA\tx\t.\tG\tA\t.\tPASS\t.\tGT\t0\t0", "ctgA\t5\t.\tG\tA\t.\tPASS\tA B\tGT\t0\t0", "ctgA\t5\t.\tG\tA\tq\tPASS\t.\tGT\t0\t0", "ctgA\t5\t.\tG", "ctgA\t5\t.\tG\tA\t1\tPASS\t.\tGT\t0"]
    assert parse_vcf(frame(spark, [*LINES, *bad]), HEADER, mode="DROPMALFORMED").count() == len(LINES)
    for line in bad:
        with pytest.raises(Exception, match="malformed VCF line"):
            parse_vcf(frame(spark, [line]), HEADER).collect()


def test_repeated_info_key_keeps_the_first(spark):
    row = parse_vcf(frame(spark, ["ctgA\t5\t.\tG\tA\t1\tPASS\tA=1;A=2;B\tGT\t0\t0"]), HEADER).first()
    assert row.attributes == {"A": ["1"], "B": []}


def test_unknown_contig_has_a_hashed_key(spark):
    row = parse_vcf(frame(spark, ["other\t5\t.\tG\tA\t1\tPASS\t.\tGT\t0\t0"]), HEADER).first()
    assert row.key & 0xFFFFFFFF == 4 and row.key >> 32 not in (0, 1)


@pytest.mark.parametrize("compression,ending", [("bgzf", ".vcf.bgz"), ("gzip", ".gz"), ("none", ".txt")])
def test_write_merge_read(spark, tmp_path, compression, ending):
    df = parse_vcf(frame(spark), HEADER)
    write_vcf(df.coalesce(1), str(tmp_path / "parts"), HEADER, write_header=False, compression=compression)
    name = {"bgzf": "all.vcf.bgz", "gzip": "all.vcf.gz", "none": "all.vcf"}[compression]
    out = merge_variants(str(tmp_path / "parts"), str(tmp_path / name), TOP)
    got = read_variants(spark, out, intervals=None)
    assert sorted(r.value for r in format_vcf(got).collect()) == sorted(LINES)
    assert read_vcf_header(out).samples == HEADER.samples
    assert read_variants(spark, out, intervals=parse_intervals("ctgA:1-6000")).count() == 2
    assert read_variants(spark, out, intervals=parse_intervals("ctgB:90-91")).count() == 1
    assert read_variants(spark, out, intervals=[]).count() == 0


def test_bgzf_lines_split_anywhere(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i * 37 % 300) for i in range(20000)]
    data = bgzf.compress("\n".join(lines).encode() + b"\n", end=True)
    path = tmp_path / "x.bgz"
    path.write_bytes(data)
    for split in (3000, 100_000, 1 << 30):
        df = spark.read.format("bgzf_lines").option("path", str(path)).option("splitSize", split).load()
        assert sorted(r.value for r in df.collect()) == sorted(lines)


def test_bcf_round_trip(spark, tmp_path):
    d = Dictionary.of(HEADER)
    for line in LINES:
        record = encode_line(line, d, d.numbers("contigs"), d.numbers("strings"))
        assert decode_record(record, 0, d, 2).split("\t")[:8] == line.split("\t")[:8]
    many = [x.replace("\t801\t", f"\t{i}\t") for i in range(1, 4001) for x in LINES[:1]]
    rows = spark.createDataFrame([(x,) for x in many], "value string").coalesce(1)
    rows.write.format("bcf").mode("append").option("header", TOP).save(str(tmp_path / "out"))
    path = str(tmp_path / "out")
    for split in (2000, 1 << 30):
        back = spark.read.format("bcf").option("path", path).option("splitSize", split).load()
        assert sorted(r.value for r in back.collect()) == sorted(many)
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert read_vcf_header(str(part)).samples == HEADER.samples
    assert read_variants(spark, path, intervals=parse_intervals("ctgA:1-10")).count() == 10
    raw = tmp_path / "raw.bcf"
    raw.write_bytes(bgzf.decompress(part.read_bytes()))
    assert spark.read.format("bcf").option("path", str(raw)).load().count() == 4000
    with pytest.raises(ValueError):
        merge_variants(path, str(tmp_path / "all.vcf"), TOP)


def test_bcf_genotypes_come_back():
    d = Dictionary.of(HEADER)
    for line in LINES:
        record = encode_line(line, d, d.numbers("contigs"), d.numbers("strings"))
        got = decode_record(record, 0, d, 2).split("\t")
        want = [":".join("." if set(v) <= {".", ","} else v for v in cell.split(":")) for cell in line.split("\t")[9:]]
        have = [":".join("." if set(v) <= {".", ","} else v for v in cell.split(":")) for cell in got[9:]]
        assert have == want


def test_plain_gzip_is_read_whole(spark, tmp_path):
    (tmp_path / "x.vcf.gz").write_bytes(gzip.compress((TOP + "\n".join(LINES) + "\n").encode()))
    assert read_variants(spark, str(tmp_path / "x.vcf.gz")).count() == 5


def test_tabix_leaves_ranges_out(spark, tmp_path):
    from helica.sources.bam_index import LinearIndex, build_tabix

    lines = [f"ctgA\t{i * 400 + 1}\t.\tA\tC\t{i % 97}\tPASS\tHITS={i * 7919 % 10007};LAB={i * 31 % 1009}\tGT\t0|1\t1|{i % 2}" for i in range(20000)]
    path = tmp_path / "x.vcf.bgz"
    path.write_bytes(bgzf.compress((TOP + "\n".join(lines) + "\n").encode(), end=True))
    (tmp_path / "x.vcf.bgz.tbi").write_bytes(build_tabix(str(path)))
    assert LinearIndex.read(str(path) + ".tbi").names == ["ctgA"]
    some = read_variants(spark, str(path), intervals=parse_intervals("ctgA:5000001-5001601"), split_size=20_000)
    assert [r.start for r in some.orderBy("start").collect()] == [5000001, 5000401, 5000801, 5001201, 5001601]
    count = lambda text: spark.read.format("bgzf_lines").option("path", str(path)).option("splitSize", 20_000).options(**({"intervals": text} if text else {})).load().rdd.getNumPartitions()
    assert 0 < count("ctgA:5000001-5001601") < count(None)
    assert read_variants(spark, str(path), intervals=parse_intervals("ctgB:1-5"), split_size=20_000).count() == 0


def test_stringency_names(spark):
    assert parse_vcf(frame(spark, ["bad"]), HEADER, mode="LENIENT").count() == 0
    with pytest.raises(ValueError):
        parse_vcf(frame(spark), HEADER, mode="ANY")


def test_typed_attributes(spark):
    from helica.sources.vcf import attribute

    df = parse_vcf(frame(spark), HEADER).select("start", *(attribute(HEADER, n).alias(n) for n in ("HITS", "SHARE", "LAB", "OLD")))
    rows = {r.start: (r.HITS, r.SHARE, r.LAB, r.OLD) for r in df.collect()}
    assert rows[801] == (9, [0.125], None, True) and rows[77003] == (None, [0.5, 0.25], None, False) and rows[5602] == (2, None, "north", False) and rows[300] == (None, None, None, False)
    with pytest.raises(ValueError):
        attribute(HEADER, "XX")


def test_lenient_warns_and_silent_does_not(spark, caplog):
    import time

    for mode, n in (("LENIENT", 1), ("SILENT", 0)):
        caplog.clear()
        with caplog.at_level("WARNING", logger="helica.sources.text_out"):
            assert parse_vcf(frame(spark, [*LINES, "bad line", "another"]), HEADER, mode=mode).count() == len(LINES)
            for _ in range(50):
                if caplog.records or not n:
                    break
                time.sleep(0.1)
        assert len(caplog.records) == n
    assert not n


def test_intervals_over_many_bins_keep_equal_rows_and_maps(spark):
    """More intervals than a predicate takes, against the predicate: rows of every width, repeated, with a map beside them."""
    import random

    from helica.functions.intervals import BIN, Interval, filter_by_intervals, overlaps

    dice = random.Random(2)
    intervals = [Interval(f"c{dice.randrange(2)}", a, a + dice.choice([0, 5, 3 * BIN])) for a in (dice.randrange(1, 400 * BIN) for _ in range(80))]
    rows = [(i, f"c{dice.randrange(3)}", a, a + dice.choice([0, 10, BIN, 7 * BIN]), {"k": "v"}) for i, a in enumerate(dice.randrange(1, 400 * BIN) for _ in range(600))]
    rows += [(None, i.contig, i.stop - BIN * 2, i.start, {}) for i in intervals[:30]] + [(None, i.contig, i.stop, i.start + BIN * 2, {}) for i in intervals[:30]]
    df = spark.createDataFrame(rows + rows[:100], "id int, contig string, start long, end long, m map<string,string>").repartition(5)
    from pyspark.sql import functions as F

    want = df.where(overlaps(intervals, F.col("contig"), F.col("start"), F.col("end")))
    got = filter_by_intervals(df, intervals)
    key = lambda r: (str(r.id), r.contig, r.start, r.end)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 50


def test_typed_bcf_equals_parsed_lines(spark, tmp_path):
    more = [*LINES, "ctgA\t9\t.\tC\tT\t.\t.\t.\tGT\t.\t0", "ctgB\t11\tx\tCC\tT\t3\tPASS\tLAB=a,b;OLD\tGT:SC\t0/1:.\t1:4"]
    rows = spark.createDataFrame([(x,) for x in more], "value string").coalesce(1)
    rows.write.format("bcf").mode("append").option("header", TOP).save(str(tmp_path / "out"))
    lines = spark.read.format("bcf").option("path", str(tmp_path / "out")).load()
    want, got = parse_vcf(lines, HEADER), read_variants(spark, str(tmp_path / "out"))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    order = lambda df: sorted((r.asDict(True) for r in df.collect()), key=lambda r: (r["contig"], r["start"]))
    assert order(got) == order(want)
    assert sorted(r.value for r in format_vcf(got).collect()) == sorted(r.value for r in lines.collect())
