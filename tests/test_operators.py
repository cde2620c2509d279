from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helica.operators.joins import is_bounded, keyed_join
from helica.operators.key_stats import heavy_keys, stats_by_key
from helica.operators.ordered import previous_row, running_start
from helica.operators.quality_units import stated_units, unify_qualities
from helica.operators.shuffles import group_by_read_name
from helica.sources.qseq_lines import parse_qseq_lines

ALIGNMENTS = "record_key long, mapq int, loaded_at timestamp, n_rows string"


def test_key_stats(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [(1, 10, day(3), "x"), (1, None, day(1), "x"), (1, 20, None, None), (2, None, None, None), (None, 5, day(2), "x"), (1, 10, day(3), "x")]
    df = spark.createDataFrame(rows, ALIGNMENTS)
    got = {r.record_key: r for r in stats_by_key(df, "record_key", first=F.min("loaded_at"), last=F.max("loaded_at"), mean=F.avg("mapq")).collect()}
    assert set(got) == {1, 2} and got[1].n_rows == 4 and got[1].first == day(1) and got[1].last == day(3) and got[1].mean == pytest.approx(40 / 3)
    assert got[2].mean is None and stats_by_key(df.limit(0), "record_key").count() == 0
    with pytest.raises(ValueError):
        stats_by_key(df, "n_rows")


def test_heavy_keys_at_the_limit(spark):
    rows = [(1, 0, None, None)] * 3 + [(2, 0, None, None)] * 4 + [(100 + i, 0, None, None) for i in range(93)] + [(None, 0, None, None)] * 50
    df = spark.createDataFrame(rows, ALIGNMENTS)
    assert [r.record_key for r in heavy_keys(df, "record_key", 0.03).collect()] == [2]
    assert heavy_keys(df.limit(0), "record_key").count() == 0


def test_partial_aggregates_shuffle(spark):
    df = spark.createDataFrame([(1, 1, None, None)], ALIGNMENTS)
    plan = stats_by_key(df, "record_key", m=F.avg("mapq"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and plan.count("Exchange") == 1


GOOD = "M1\t3\t1\t2\t-3\t4\tAC.T\t1\tACGT\tabcd\t1"


def line(**new):
    names = ["instrument", "run", "lane", "tile", "xpos", "ypos", "index", "read", "sequence", "quality", "filter"]
    return "\t".join(new.get(n, v) for n, v in zip(names, GOOD.split("\t")))


CASES = [
    (GOOD, None), (GOOD + "\r", None), (line(index="0"), None), ('"M""1\tx"' + GOOD[2:], None), (line(filter='"1"'), None), (line(run='"00003"'), None), (line(quality="~@@@"), None), (line(instrument=""), None),
    (line(instrument='a"b'), "quoting"), (line(instrument='"ab'), "quoting"), (line(filter='1"'), "quoting"), (line(instrument='"a"b'), "quoting"), ('"' * 100_001, "quoting"), (line(index='"0" '), "quoting"),
    ("", "columns"), (None, "columns"), (GOOD + "\tx", "columns"), ("# truncated", "columns"), ('""', "columns"), (GOOD.replace("\t", " "), "columns"),
    (line(run="x"), "number"), (line(run="2147483648"), "number"), (line(run="+5"), "number"), (line(ypos=""), "number"), (line(read=" 1"), "number"), (line(xpos="1.0"), "number"), (line(lane="--1"), "number"),
    (line(sequence=""), "bases"), (line(sequence="ACGX"), "bases"), (line(index="acgt"), "bases"), (line(index=""), "bases"), (line(sequence="ACG\n"), "bases"),
    (line(quality="abc "), "quality"), (line(quality="abc\x7f"), "quality"), (line(quality="abc"), "length"), (line(quality=""), "length"),
    (line(filter="2"), "filter_flag"), (line(filter=""), "filter_flag"), (GOOD + "\r\r", "filter_flag"), (line(sequence="A" * 300_000), "length"),
]


def test_qseq_reasons(spark):
    df = spark.createDataFrame([(i, t, "kept", None) for i, (t, _) in enumerate(CASES)], "line_id int, raw_line string, errors string, run int")
    good, bad = parse_qseq_lines(df)
    got = {r.line_id: r.fail_reason for r in bad.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES) if reason}
    rows = {r.line_id: r for r in good.collect()}
    assert set(rows) | set(got) == set(range(len(CASES))) and not set(rows) & set(got)
    assert rows[0]["index"] == "ACNT" and rows[2]["index"] is None and rows[3].instrument == 'M"1\tx' and rows[0].xpos == -3 and rows[0].filter_passed is True
    assert rows[0].input_errors == "kept" and "input_run" in good.columns and rows[0].run == 3
    assert [d.count() for d in parse_qseq_lines(df.limit(0))] == [0, 0]


RUNS = "run_id long, quality_encoding string, run_note string"
FRAGMENTS = "fragment_id long, run_id long, lane int, seq_bases string, quality string, unit string"


def test_stated_units(spark):
    rows = [
        (1, "Phred+33", None), (2, "ILLUMINA 1.5", "Run paused for 33 minutes."), (3, None, "Chiller alarm at cycle 64, no loss. 64 tiles were rescanned."), (4, "n/a", "offset 33 up to lane 5; from lane 6 on offset 64."),
        (5, "", "Lane 3 underloaded. Lanes below 4 carry ASCII offset 64, lane 4 and above offset 33."), (6, "unknown", "qualities: log10 of P(error)"), (7, None, "Each base has its error probability instead of a score."), (8, "Phred, numeric", None),
        (9, "P(err)", None), (10, None, "Quality characters start at the at sign, so subtract 64."), (11, None, "Scores were left as the base-ten logarithm of the error probability."), (12, "Illumina 1.8+", None), (None, "numeric", None), (13, "log10(P)", None), (14, None, None),
    ]
    got = {r.run_id: (r.lane_cut, r.unit_below, r.unit_from) for r in stated_units(spark.createDataFrame(rows, RUNS)).collect()}
    one = lambda u: (None, u, u)
    assert got == {
        1: one("phred33"), 2: one("phred64"), 3: one(None), 4: (6, "phred33", "phred64"), 5: (4, "phred64", "phred33"), 6: one("log10"), 7: one("errprob"), 8: one("decimal"),
        9: one("errprob"), 10: one("phred64"), 11: one("log10"), 12: one("phred33"), 13: one("log10"), 14: one(None),
    }


def test_units_by_values_and_statement(spark):
    runs = spark.createDataFrame([(1, None, None), (2, "phred33", None), (3, None, "offset 33 up to lane 5; from lane 6 on offset 64.")], RUNS)
    cases = {
        10: (1, 1, "ACG", "!5J", "phred33", "!5J"), 11: (1, 1, "ACG", "hhT", "phred64", "II5"), 12: (1, 1, "ACG", "40 0;41", None, None), 13: (1, 1, "ACG", "40,0,41", "decimal", "I!J"),
        14: (1, 1, "ACG", "1.000e-04 6.310e-01 1", "errprob", "I#!"), 15: (1, 1, "ACG", "-4.0;-0.2;-1", "log10", "I#+"), 16: (1, 1, "AC", "GG", None, None), 17: (2, 1, "AC", "GG", "phred33", "GG"),
        18: (3, 5, "AC", "GG", "phred33", "GG"), 19: (3, 6, "AC", "GG", "phred64", "(("), 20: (3, None, "ACG", "!5J", "phred33", "!5J"), 21: (1, 1, "ACG", None, None, None), 22: (None, 1, "ACG", "40,0,41", "decimal", "I!J"),
        23: (1, 1, "ACG", "40,0", None, None), 24: (1, 1, None, "40,0", None, None), 25: (1, 1, "A" * 50_000, "I" * 50_000, None, None), 26: (1, 1, "A" * 20_000, ",".join(["38"] * 20_000), "decimal", "G" * 20_000), 27: (1, 1, "AC", "0,0", None, None), 28: (1, 1, "AC", "50,2", None, None),
    }
    del cases[12]
    # The length of a read does not matter, nor do two digits; a score of 42 and parts of scores are none.
    cases |= {29: (1, 1, "A" * 6000, " ".join(["7.9e-05"] * 6000), "errprob", "J" * 6000), 30: (1, 1, "AC", "-4.2 -1", None, None), 31: (1, 1, "AC", "30.5 2", None, None), 32: (1, 1, "AC", "!K", None, None), 33: (1, 1, "ACG", "!5", None, None), 34: (1, 1, "AC", "é!", None, None), 35: (1, 1, "", "", None, None)}
    rows = [(i, r, lane, s, q, "mine") for i, (r, lane, s, q, _, _) in cases.items()]
    df = unify_qualities(spark.createDataFrame(rows + rows[:1], FRAGMENTS), runs)
    got = df.collect()
    assert len(got) == len(rows) + 1
    assert {r.fragment_id: (r.unit, r.quality_phred33) for r in got} == {i: (u, q33) for i, (*_, u, q33) in cases.items()}
    assert {r.fragment_id for r in got if r.unit_ambiguous} == {16, 24, 25, 27, 35} and {r.input_unit for r in got} == {"mine"}
    assert {r.unit_source for r in got if r.fragment_id in (17, 18, 19)} == {"stated"}
    assert unify_qualities(df.select("fragment_id", "run_id", "lane", "seq_bases", "quality").limit(0), runs.limit(0)).count() == 0


def test_keyed_join_both_ways(spark):
    large = spark.createDataFrame([(i % 3 if i % 5 else None, i, i) for i in range(300)], "k int, v int, `a.b` int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, w string")
    for how in ("left", "inner"):
        want = sorted(map(str, large.join(small, ["k"], how).collect()))
        for limit in (10, 1):
            assert sorted(map(str, keyed_join(large, small, ["k"], how, max_rows=limit, salts=4).collect())) == want
    assert is_bounded(small, 2) and not is_bounded(small, 1)


def test_previous_row_over_chunks(spark):
    rows = [("a", s, i) for i, s in enumerate([5, 1, 9000, 4096, 4095, 70000, 9000])] + [(None, 1, 90), ("a", None, 91)]
    df = spark.createDataFrame(rows, "g string, s int, id int")
    for span in (1, 100, 4096, 1 << 20):
        got = {r.id: r.previous for r in previous_row(df, "g", "s", "id", "id", span).collect()}
        assert got == {1: None, 0: 1, 4: 0, 3: 4, 2: 3, 6: 2, 5: 6, 90: None, 91: None}


def test_running_start_over_chunks(spark):
    df = spark.createDataFrame([("a", i, i // 3, 2) for i in range(10)] + [("b", 1, 0, 5)], "g string, i int, c int, w int")
    got = {(r.g, r.i): r.start for r in running_start(df, ["g"], "c", ["i"], F.col("w")).collect()}
    assert got == {("a", i): 2 * i for i in range(10)} | {("b", 1): 0}


def test_reads_of_a_name_are_neighbours(spark):
    df = spark.range(100).select((F.col("id") % 7).cast("string").alias("read_name"), "id").repartition(5)
    out = group_by_read_name(df, 3).select("read_name", F.spark_partition_id().alias("p")).collect()
    assert len(out) == 100 and len({(r.read_name, r.p) for r in out}) == 7
