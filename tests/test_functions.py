import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helica.functions import offsets
from helica.functions.hashing import hash_text, murmur_bytes, murmur_chars
from helica.functions.intervals import Interval, filter_by_intervals, format_intervals, merge_intervals, parse_intervals
from helica.functions.keys import coordinate_key, read_key, unplaced_last
from helica.functions.names import parse_boolean


def test_hash_of_known_texts():
    assert murmur_bytes([b"hello"])[0] == np.uint64(0xCBD8A7B341BD9B02).astype(np.int64)
    assert murmur_bytes([b"The quick brown fox jumps over the lazy dog"])[0] == 0x2FB593E0D8E6B8DE
    assert murmur_bytes([b""])[0] == 0 and len(murmur_bytes([])) == 0


@given(st.lists(st.binary(max_size=70), max_size=6))
def test_hash_does_not_depend_on_neighbours(values):
    together = murmur_bytes(values)
    assert [murmur_bytes([v])[0] for v in values] == together.tolist()


def test_hash_of_characters_takes_its_tail_from_the_start():
    assert murmur_chars(["readname-001"])[0] == murmur_chars(["readname-002"])[0]
    assert murmur_chars(["abc"])[0] != murmur_chars(["abd"])[0]


def test_hash_column_keeps_null(spark):
    rows = spark.createDataFrame([("chr1",), (None,)], "s string").select(hash_text("s").alias("h")).collect()
    assert rows[0].h == murmur_chars(["chr1"])[0] and rows[1].h is None


def test_keys(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 20, 1000), (0, 3, 0), (4, 3, 7), (0, -1, 0)], "flags int, ref_index int, start int")
    assert [r[0] for r in df.select(coordinate_key(F.col("ref_index"), F.col("start"))).collect()][:3] == [0, (20 << 32) | 999, -1]
    c = F.col
    keys = [r[0] for r in df.select(read_key(c("flags"), c("ref_index"), c("start"), F.lit("n"), F.lit("ACG"), F.lit("III"), F.lit("*"))).collect()]
    assert keys[1] == (20 << 32) | 999 and keys[3] == keys[4] and (keys[3] < 0 or keys[3] >> 32 == 2**31 - 1)
    order = df.orderBy(*unplaced_last(c("flags"), c("ref_index"), c("start"))).collect()
    assert [r.flags or r.ref_index for r in order][-2:] == [-1, 4]


def test_interval_texts():
    good = ["chr1:1-343", "chr20_Un:31-145", "X:31-145", "10:45000012-678901123", "HLA-DQA1*01:01:02:134-14151"]
    assert format_intervals(parse_intervals(",".join(good))) == ",".join(good)
    assert parse_intervals(None) is None and parse_intervals("") == []
    assert parse_intervals("HLA-DQA1*01:01:02:134-14151")[0].contig == "HLA-DQA1*01:01:02"
    for bad in ("chr1", "chr1:12", "chr1,chr2:121-123", "chr20:1,100-3,400", "MT:35+", "MT:13-31-1112", "MT:-2112", " MT : 113 - 1245"):
        with pytest.raises(ValueError):
            parse_intervals(bad)


def test_merged_intervals():
    assert merge_intervals([Interval("a", 5, 9), Interval("a", 1, 4), Interval("b", 1, 2), Interval("a", 20, 30), Interval("a", 25, 26)]) == [("a", 1, 9), ("a", 20, 30), ("b", 1, 2)]


def test_many_intervals_are_a_join_with_the_same_result(spark):
    df = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("contig"), (F.col("id") * 37 % 90_000).alias("start")).withColumn("end", F.col("start") + F.pmod(F.col("start"), F.lit(40_000)))
    df = df.unionByName(spark.createDataFrame([(None, 5, 5)], df.schema))
    spans = [Interval(f"c{i % 3}", i * 900, i * 900 + i) for i in range(100)]
    found = filter_by_intervals(df, spans)
    assert "LeftSemi" in found._jdf.queryExecution().toString()
    want = {(r.contig, r.start, r.end) for r in df.collect() if any(r.contig == s.contig and r.start <= s.stop and r.end >= s.start for s in spans)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert filter_by_intervals(df, spans, unplaced=True).count() == len(want) + 1


@pytest.mark.parametrize("n", [64, 65])
def test_repeated_rows_over_a_bin_border_stay_repeated(spark, n):
    b = 1 << 14
    # The first two spans lie in the two bins of the same rows.
    spans = [Interval("a", b - 5, b - 3), Interval("a", b + 3, b + 5), *(Interval("b", 10 * i, 10 * i + 5) for i in range(1, n - 1))]
    rows = 3 * [("a", b - 10, b + 10)] + 2 * [("a", b - 4, b + 1)] + 2 * [("a", b - 1, b + 1)] + 2 * [("a", 1, 3 * b)] + 2 * [("a", b + 3, b + 4)]
    df = spark.createDataFrame(rows, "contig string, start int, end int").repartition(3)
    want = sorted(3 * [("a", b - 10, b + 10)] + 2 * [("a", b - 4, b + 1)] + 2 * [("a", 1, 3 * b)] + 2 * [("a", b + 3, b + 4)])
    assert len(merge_intervals(spans)) == n and sorted(map(tuple, filter_by_intervals(df, spans).collect())) == want


def test_virtual_offsets(spark):
    df = spark.createDataFrame([(5, 9), (2**40, 65535)], "b long, i int")
    v = df.select(offsets.pack(F.col("b"), F.col("i")).alias("v"))
    r = v.select(offsets.block_of(F.col("v")), offsets.inside_of(F.col("v")), offsets.shifted(F.col("v"), F.lit(3))).collect()
    assert [tuple(x) for x in r] == [(5, 9, 8 << 16 | 9), (2**40, 65535, (2**40 + 3) << 16 | 65535)]
    n = spark.range(1).select(offsets.split_length(F.lit(5 << 16 | 2), F.lit(5 << 16 | 9)), offsets.split_length(F.lit(5 << 16), F.lit(9 << 16))).first()
    assert tuple(n) == (7, 4)


def test_booleans():
    for t in ("yes", "True", " t", "y", "1"):
        assert parse_boolean(t, False) is True
    for t in ("no", "FALSE", "f ", "n", "0"):
        assert parse_boolean(t, True) is False
    assert parse_boolean(None, True) is True
    with pytest.raises(ValueError):
        parse_boolean("maybe", True)
