import os

import pytest
from pyspark.sql import functions as F

from helica.functions.intervals import parse_intervals
from helica.sources import bgzf
from helica.sources.bam_codec import decode_tags, encode_tags, read_bam_header
from helica.sources.bam_index import BlockIndex, LinearIndex, SplittingIndex, SplittingIndexBuilder, build_bai, build_block_index, build_splitting_index
from helica.sources.files import size_of
from helica.sources.merge import merge_reads
from helica.sources.reads import load_reads, read_bam, read_sam_header, write_reads
from helica.sources.sam import READ_COLUMNS, SamHeader, check_traversal, parse_sam, read_sam, tag_structs
from tests.make_reads import HEADER, read_rows, reads


@pytest.fixture(scope="module")
def bam(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    write_reads(reads(spark), str(folder / "parts.bam"), HEADER, write_header=False, splitting_index=True, granularity=10)
    return merge_reads(str(folder / "parts.bam"), str(folder / "all.bam"), HEADER)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*READ_COLUMNS).collect())


def test_bam_round_trip(spark, bam):
    assert rows_of(read_bam(spark, bam)) == sorted(read_rows())
    header, begin = read_bam_header(bam)
    assert header.contigs == HEADER.contigs and header.text == HEADER.text and begin > 0


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("split", [1000, 7000, 1 << 20])
def test_bam_splits_have_every_record_once(spark, bam, tmp_path, index, split):
    path = str(tmp_path / "x.bam")
    os.symlink(bam, path)
    if index:
        os.symlink(bam + ".splitting-bai", path + ".splitting-bai")
    df = read_bam(spark, path, splitSize=split)
    assert rows_of(df) == sorted(read_rows())
    if split == 1000:
        assert df.rdd.getNumPartitions() >= 4


@pytest.mark.parametrize(
    "intervals,unplaced,n",
    [("chr9:5000-9999,chr9:20000-22999", False, 23), ("chr9:1-700000", False, 2000), ("chr9:5000-9999,chr9:20000-22999", True, 25), (None, True, 2), (None, False, 2002), ("", False, 0)],
)
def test_interval_selection(spark, bam, intervals, unplaced, n):
    assert read_bam(spark, bam, parse_intervals(intervals), unplaced).count() == n
    assert load_reads(spark, bam, parse_intervals(intervals), unplaced).count() == n


def test_selection_of_nothing_is_an_error():
    with pytest.raises(ValueError):
        check_traversal(None, False)


def test_unknown_contig_is_an_error(spark, bam):
    with pytest.raises(Exception, match="not in the header"):
        read_bam(spark, bam, parse_intervals("nope:1-2")).count()


def test_column_selection_leaves_others_null(spark, bam):
    r = read_bam(spark, bam, columns="read_name,start").first()
    assert r.read_name == "frag.0" and r.start == 501 and r.bases is None and r.tags is None


def test_pairing_option_is_an_error(spark, bam):
    with pytest.raises(Exception, match="no longer"):
        read_bam(spark, bam, keepPairedReadsTogether="true").count()


def test_bai_prunes_and_splits(spark, bam, tmp_path):
    path = str(tmp_path / "x.bam")
    os.symlink(bam, path)
    with open(path + ".bai", "wb") as f:
        f.write(build_bai(bam))
    index = LinearIndex.read(path + ".bai")
    span = index.chunks([(8, 500_000, 501_000)])
    assert span and span[0][0] >> 16 > 0
    some = read_bam(spark, path, parse_intervals("chr9:690000-691300"), splitSize=2000)
    assert some.count() == 4
    assert some.rdd.getNumPartitions() < read_bam(spark, path, splitSize=2000).rdd.getNumPartitions()
    assert rows_of(read_bam(spark, path, baiSplits="true", splitSize=5000)) == sorted(read_rows())
    assert read_bam(spark, path, parse_intervals("chr9:690000-691300"), True, splitSize=2000).count() == 6


@pytest.mark.parametrize("granularity", [2, 10, 4096])
def test_splitting_index_of_file_and_of_writer(spark, bam, granularity, tmp_path):
    data = build_splitting_index(bam, granularity)
    offsets = [int.from_bytes(data[i : i + 8], "big") for i in range(0, len(data), 8)]
    assert offsets[-1] == size_of(bam) << 16 and len(offsets) == 1 + 2002 // granularity + 1
    if granularity == 10:
        assert SplittingIndex.read(bam + ".splitting-bai").offsets == offsets
    index = SplittingIndex(offsets)
    assert index.previous(0) is None and index.next(0) == offsets[0]
    assert index.previous(index.file_size) == offsets[-1] and index.next(index.file_size) is None


def test_bad_splitting_indexes():
    for bad in ([], [5, 3]):
        with pytest.raises(ValueError):
            SplittingIndex(bad)
    with pytest.raises(ValueError):
        SplittingIndexBuilder(0)


def test_block_index(bam, tmp_path):
    data = build_block_index(bam, 2)
    path = tmp_path / "x.bgzfi"
    path.write_bytes(data)
    index = BlockIndex.read(str(path))
    addresses = [a for a, _, _ in bgzf.block_addresses(bam)]
    assert index.offsets == sorted({0, *addresses[1::2], size_of(bam)})
    assert index.previous(0) == 0 and index.next(size_of(bam)) is None


def test_empty_write_and_merge(spark, tmp_path):
    write_reads(reads(spark).where("false"), str(tmp_path / "p.bam"), HEADER, write_header=False)
    out = merge_reads(str(tmp_path / "p.bam"), str(tmp_path / "all.bam"), HEADER)
    assert read_bam(spark, out).count() == 0


def test_many_parts_keep_all_reads_in_order(spark, tmp_path):
    df = reads(spark, 2000).repartitionByRange(5, "ref_index", "start").sortWithinPartitions("ref_index", "start")
    write_reads(df, str(tmp_path / "p.bam"), HEADER, write_header=False, splitting_index=True, granularity=100)
    out = merge_reads(str(tmp_path / "p.bam"), str(tmp_path / "all.bam"), HEADER, delete_parts=True)
    assert not os.path.exists(tmp_path / "p.bam")
    assert read_bam(spark, out, splitSize=10_000).count() == 4002
    assert bgzf.TERMINATOR == open(out, "rb").read()[-28:]


def test_unfinished_write_is_not_merged(tmp_path):
    with pytest.raises(FileNotFoundError):
        merge_reads(str(tmp_path), str(tmp_path / "sub" / "x.bam"), HEADER)


SAM = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:scaf3\tLN:70000\n@RG\tID:g\tSM:fox\nr1\t1089\tscaf3\t4100\t37\t3M2D2M1S\t=\t4500\t-90\tACGTNA\tIIII#I\tXQ:i:8\tRG:Z:g\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def test_sam_text(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    df = read_sam(spark, str(path))
    a, b = df.orderBy("read_name").collect()
    assert (a.start, a.end, a.contig, a.mate_contig, a.ref_index, a.tags) == (4100, 4106, "scaf3", "scaf3", 0, "XQ:i:8\tRG:Z:g")
    assert (b.contig, b.ref_index, b.start, b.bases, b.tags) == (None, -1, 0, "*", "")
    assert df.select(tag_structs(F.col("tags")).alias("t")).first().t[1].asDict() == {"tag": "RG", "type": "Z", "value": "g"}
    write_reads(df.orderBy("read_name").coalesce(1), str(tmp_path / "out.sam"), read_sam_header(str(path)))
    text = next(p for p in (tmp_path / "out.sam").iterdir() if p.name.startswith("part")).read_text()
    assert text == SAM


def test_sam_without_header_and_broken_lines(spark):
    lines = spark.createDataFrame([("r\t0\tchr1\t5\t1\t3M\t*\t0\t0\tACG\tIII",), ("broken\t1",), ("r\tx\tchr1\t5\t1\t3M\t*\t0\t0\tACG\tIII",), ("",)], "value string")
    assert parse_sam(lines, SamHeader(), mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="malformed SAM line"):
        parse_sam(lines, SamHeader()).collect()


def test_mixed_formats(spark, bam, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    os.symlink(bam, tmp_path / "y.bam")
    assert load_reads(spark, str(tmp_path)).count() == 2004
    with pytest.raises(ValueError):
        load_reads(spark, str(tmp_path), formats={})


def test_broken_cram_is_an_error(spark, tmp_path):
    (tmp_path / "x.cram").write_bytes(b"CRAM")
    with pytest.raises(Exception):
        load_reads(spark, str(tmp_path / "x.cram")).count()


def test_output_needs_format_and_header(spark):
    with pytest.raises(ValueError):
        write_reads(reads(spark, 1), "out", HEADER)
    with pytest.raises(ValueError):
        write_reads(reads(spark, 1), "out.bam", None)


def test_tags_of_every_type():
    text = "XA:A:q\tXi:i:-7\tXu:i:4000000000\tXf:f:1.5\tXZ:Z:a b:c\tXH:H:1AE3\tXB:B:c,-1,2\tXS:B:f,1.5,2"
    assert decode_tags(encode_tags(text)) == text
    assert encode_tags(None) == encode_tags("") == b""


def test_sorted_header():
    assert SamHeader.parse("@SQ\tSN:a\tLN:5\n").sorted_by("coordinate").text.startswith("@HD\tVN:1.6\tSO:coordinate\n")
    assert "SO:queryname" in HEADER.sorted_by("queryname").text and "SO:coordinate" not in HEADER.sorted_by("queryname").text


def test_tools(spark, bam, tmp_path, capsys):
    from helica.tools import main

    path = str(tmp_path / "x.bam")
    os.symlink(bam, path)
    for args in (["index-records", path, "--granularity", "10"], ["index-blocks", path, "--granularity", "1"], ["index-bai", path], ["show-records", path + ".splitting-bai"], ["show-blocks", path + ".bgzfi"], ["blocks", path], ["header", path, "--sorted-by", "queryname"]):
        assert main(args) == 0
    assert SplittingIndex.read(path + ".splitting-bai").offsets == SplittingIndex.read(bam + ".splitting-bai").offsets
    capsys.readouterr()
    main(["first-read", path, "0"])
    begin = read_bam_header(bam)[1]
    assert capsys.readouterr().out == f"{begin >> 16}:{begin & 65535}\n"


def test_filters_reach_the_scan(spark, bam, tmp_path):
    path = str(tmp_path / "x.bam")
    os.symlink(bam, path)
    with open(path + ".bai", "wb") as f:
        f.write(build_bai(bam))
    df = read_bam(spark, path, splitSize=2000).where("contig = 'chr9' and start <= 691300 and end >= 690000")
    assert sorted(r.start for r in df.collect()) == [690001, 690161, 690701, 690861]
    assert df.rdd.getNumPartitions() < read_bam(spark, path, splitSize=2000).rdd.getNumPartitions()
    assert read_bam(spark, path).where("contig = 'nope'").count() == 0
    assert read_bam(spark, path).where("contig = 'chr9' and start = 690001 or flags = 4 and contig is null").count() == 3


def test_reads_of_odd_shapes(spark, tmp_path):
    from tests.make_reads import read_rows as rows_for

    base = list(rows_for(1)[0])
    names = READ_COLUMNS
    odd = []
    for i, change in enumerate([{}, {"bases": "*", "quals": "*"}, {"quals": "*"}, {"bases": "A", "quals": "I"}, {"bases": "ACGTNRYKM=", "quals": "!" * 10}, {"tags": ""}, {"bases": "AC" * 60_000 + "G", "quals": "J" * 120_001}, {"cigar": "*"}, {"cigar": "5S10M2D3I18M", "end": 530}]):
        row = dict(zip(names, base)) | {"read_name": f"odd{i}"} | change
        if row["cigar"] == "*":
            row["end"] = row["start"]
        odd.append(tuple(row[c] for c in names))
    df = spark.createDataFrame(odd, reads(spark, 1).schema)
    write_reads(df.coalesce(1), str(tmp_path / "x.bam"), HEADER)
    assert rows_of(read_bam(spark, str(tmp_path / "x.bam"))) == sorted(odd)
    for change in ({"contig": "nope"}, {"quals": "II"}):
        bad = dict(zip(names, base)) | change
        with pytest.raises(Exception, match="not in the header|qualities for"):
            write_reads(spark.createDataFrame([tuple(bad[c] for c in names)], df.schema), str(tmp_path / ("y" + next(iter(change)) + ".bam")), HEADER)


def test_writes_and_merges_by_uri(spark, tmp_path, monkeypatch):
    """A file system that only pyarrow knows, here a local one under another name."""
    from pyarrow import fs

    from helica.sources import files

    class Seen:
        @staticmethod
        def of(path):
            return fs.LocalFileSystem(), path.removeprefix("elsewhere://")

    monkeypatch.setattr(files, "_filesystem", Seen.of)
    uri = f"elsewhere://{tmp_path}/parts.bam"
    folder = tmp_path / "parts.bam"
    write_reads(reads(spark, 200, 3).repartition(3), str(folder), HEADER, write_header=False, splitting_index=True)
    from helica.sources.merge import part_files

    assert [p.rsplit("/", 1)[1] for p in part_files(uri)] == [f"part-0000{i}.bam" for i in range(3)]
    out = merge_reads(uri, f"elsewhere://{tmp_path}/all.bam", HEADER)
    assert files.exists(out + ".splitting-bai") and load_reads(spark, str(tmp_path / "all.bam")).count() == 402
    files.make_folder(f"elsewhere://{tmp_path}/new/sub")
    with files.create(f"elsewhere://{tmp_path}/new/sub/x") as f:
        f.write(b"1")
    files.move(f"elsewhere://{tmp_path}/new/sub/x", f"elsewhere://{tmp_path}/new/sub/y")
    assert files.names_in(f"elsewhere://{tmp_path}/new/sub") == ["y"] and files.names_in(f"elsewhere://{tmp_path}/none") == []
    files.delete(f"elsewhere://{tmp_path}/new/sub/y")
    files.delete_folder(f"elsewhere://{tmp_path}/new")
    assert not (tmp_path / "new").exists()
    with pytest.raises(ValueError):
        merge_reads(uri, uri + "/all.bam", HEADER)


def test_keys_of_placed_reads_cost_no_python(spark, bam, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = load_reads(spark, bam)
    assert "ArrowEvalPython" not in plan(df) and df.where("key is null").count() == 0
    (tmp_path / "x.sam").write_text(SAM)
    keyless = load_reads(spark, str(tmp_path / "x.sam"), key=False)
    assert "ArrowEvalPython" not in plan(keyless) and "ArrowEvalPython" not in plan(load_reads(spark, str(tmp_path / "x.sam")).select("read_name"))


def test_a_large_header_is_read_once_in_bounded_time(tmp_path):
    import time

    from helica.sources.bam_codec import header_bytes

    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:c{i}\tLN:1000\n" for i in range(3000)) + "@CO\t" + "x" * 60_000_000 + "\n"
    header = SamHeader.parse(text)
    (tmp_path / "x.bam").write_bytes(bgzf.compress(header_bytes(header), 1, end=True))
    began = time.time()
    got, begin = read_bam_header(str(tmp_path / "x.bam"))
    assert got.contigs == header.contigs and len(got.text) == len(text) and time.time() - began < 20
    assert begin >> 16 == size_of(str(tmp_path / "x.bam")) - len(bgzf.TERMINATOR) or begin & 0xFFFF


def test_a_header_that_is_written_again_is_read_again(tmp_path):
    from helica.sources.bam_codec import header_bytes

    path = tmp_path / "x.bam"
    for name in ("one", "two", "seven"):
        path.write_bytes(bgzf.compress(header_bytes(SamHeader.of_contigs([(name, 5)])), end=True))
        assert read_sam_header(str(path)).names == [name]
