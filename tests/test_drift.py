import itertools

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from helica.operators import drift as D
from helica.operators import variant_drift as V

FILES = "file_id long, cohort_id string, file_seq int, sample_names_in_order array<string>, version string"
FIELDS = "file_id long, dict_pos int, field_class string, field_id string, value_type string, value_count string, field_text string, kind string"
VARIANTS = "variant_id long, file_id long, contig string, pos int, var_name string, ref_allele string, alt_alleles string, qual double, filters string, info_raw string, format_pos array<int>, genotypes_raw string, loaded_at timestamp, samples string"


@given(st.integers(0, 4), st.integers(0, 4), st.data())
def test_best_assignment_equals_all_permutations(n, m, data):
    cells = st.one_of(st.just(-np.inf), st.integers(0, 20).map(float))
    score = np.array([[data.draw(cells) for _ in range(m)] for _ in range(n)]).reshape(n, m)
    got = D.best_assignment(score)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(np.isfinite(score[p]) for p in got)
    best = (0, 0.0)
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                total = [score[i, j] for i, j in zip(rows, cols)]
                if all(np.isfinite(total)):
                    best = max(best, (k, float(sum(total))))
    assert (len(got), float(sum(score[p] for p in got))) == best


def field(f, pos, cls, name, kind="Integer", n="1", text="text"):
    return (f, pos, cls, name, kind, n, text, "x")


def tables(spark, files, fields, variants=()):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(fields, FIELDS), spark.createDataFrame(list(variants), VARIANTS)


def found(spark, files, fields, variants=()):
    return {(r.version, r.kind, r.name, r.change) for r in V.dictionary_changes(*tables(spark, files, fields, variants)).collect()}


def test_changes_by_hand(spark):
    files = [(1, "c", 1, [" a", "b ", "c"], ""), (2, "c", 3, ["b", "a", "d"], ""), (3, "c", 9, None, ""), (4, "other", 2, ["a"], ""), (5, None, 1, ["a"], ""), (6, "c", None, ["z"], ""), (2, "c", 3, ["b", "a", "d"], "")]
    fields = [
        field(1, 1, "INFO", "DP", text="Depth  of reads"), field(1, 2, "INFO", "AF", "Float"), field(1, 3, "FORMAT", "GT", "String", text="Calls"), field(1, 4, "INFO", "OLD", text="Goes away"),
        field(2, 9, "INFO", "DPX", "INTEGER", text=" depth of READS"), field(2, 1, "INFO", "AF", "float", "A"), field(2, 3, "FORMAT", "GT", "string", text="Other text"), field(2, 5, "FORMAT", "OLD", text="Goes away"), field(2, 5, "FORMAT", "OLD", text="Goes away"),
        field(None, 1, "INFO", "X"), field(2, 1, None, "X"), field(2, 1, "INFO", None), field(4, 1, "INFO", "Z"),
    ]
    want = {
        (2, "INFO", "DPX", "renamed"), (2, "INFO", "AF", "retyped"), (2, "INFO", "OLD", "removed"), (2, "FORMAT", "OLD", "added"),
        (2, "SAMPLE", "c", "removed"), (2, "SAMPLE", "d", "added"), (2, "SAMPLE", "*", "reordered"),
        (3, "SAMPLE", "b", "removed"), (3, "SAMPLE", "a", "removed"), (3, "SAMPLE", "d", "removed"),
        (3, "INFO", "DPX", "removed"), (3, "INFO", "AF", "removed"), (3, "FORMAT", "GT", "removed"), (3, "FORMAT", "OLD", "removed"),
    }
    assert found(spark, files, fields) == want


def test_equal_texts_are_told_apart_by_type_and_values(spark):
    files = [(1, "c", 1, [], ""), (2, "c", 2, [], "")]
    fields = [field(1, 1, "FORMAT", "A1"), field(1, 2, "FORMAT", "B1"), field(2, 1, "FORMAT", "XX"), field(2, 2, "FORMAT", "YY")]
    row = lambda i, f, a, b: (i, f, "chr1", 5, None, "A", "T", 1.0, None, None, [1, 2], f"{a}:{b}", None, None)
    variants = [row(i, 1, 9000 + i, 1) for i in range(20)] + [row(50 + i, 2, 2, 9100 + i) for i in range(20)]
    ch = V.dictionary_changes(*tables(spark, files, fields, variants)).collect()
    assert {(r.name, r.old_name) for r in ch} == {("XX", "B1"), ("YY", "A1")}


def test_more_new_fields_than_gone_ones(spark):
    files = [(1, "c", 1, [], ""), (2, "c", 2, [], "")]
    assert found(spark, files, [field(1, 1, "INFO", "AB"), field(2, 1, "INFO", "ABX"), field(2, 2, "INFO", "QQQ")]) == {(2, "INFO", "ABX", "renamed"), (2, "INFO", "QQQ", "added")}


def test_matching_by_likeness_when_texts_need_not_be_equal():
    one = {"name": "price", "text": "price of a unit", "type": "double", "count": None, "sketch": [1.0, 3.2]}
    other = {"name": "unit_price", "text": "price of a unit", "type": "double", "count": None, "sketch": [1.0, 3.1]}
    far = {"name": "zip", "text": None, "type": "string", "count": "2", "sketch": [0.0, 0.0]}
    assert D.match_fields([one], [far, other], False) == [(0, 1)]
    assert D.match_fields([one], [far], False) == [] and D.match_fields([{**one, "text": ""}], [{**other, "text": ""}], True) == []


def test_one_table_of_all_variants(spark):
    files = [(1, "c", 1, ["s1", "s2"], ""), (2, "c", 2, ["s2", "s3"], ""), (3, "c", 3, ["s1"], "")]
    fields = [field(1, 1, "FORMAT", "GT", "String", text="Calls"), field(1, 2, "INFO", "DP", text="Depth"), field(2, 7, "FORMAT", "G2", "String", text="calls"), field(2, 3, "INFO", "D2", "Float", text="DEPTH"), field(3, 4, "FORMAT", "G3", "String", text="Calls"), field(3, 5, "FORMAT", "GT", "String", text="New one")]
    v = lambda i, f, info, pos, g, ts="2024-01-01 00:00:00": (i, f, "chr1", 5, None, "A", "T,C", 1.0, None, info, pos, g, __import__("datetime").datetime.fromisoformat(ts), "clash")
    variants = [v(10, 1, "DP=5;DB", [1], "0/1\t1/1"), v(11, 2, "D2=7", [7, 99], "0/0:x\t."), v(11, 2, "D2=8", [7], "1/1\t1/1", "2025-01-01 00:00:00"), v(12, 3, None, [4, 5], "0/1:q"), v(13, None, None, None, None), v(None, 1, None, None, None)]
    t = tables(spark, files, fields, variants)
    ch = V.dictionary_changes(*t)
    rows = {(r.variant_id, r.sample_name): r for r in V.unify_variants(*t, ch).collect()}
    assert set(rows) == {(10, "s1"), (10, "s2"), (11, "s2"), (11, "s3"), (12, "s1"), (13, None)}
    pairs = lambda x: [tuple(e)[:2] for e in x]
    assert pairs(rows[10, "s2"].format_values) == [("GT", "1/1")] and pairs(rows[10, "s1"].info_values) == [("DP", "5"), ("DB", None)]
    assert pairs(rows[11, "s2"].format_values) == [("GT", "0/0")] and pairs(rows[11, "s2"].info_values) == [("DP", "7")]
    assert pairs(rows[12, "s1"].format_values) == [("GT", "0/1"), ("GT@2", "q")]  # the calls go on, the name is used again for another field
    assert rows[11, "s2"].info_values[0].number == 7.0 and rows[10, "s1"].info_values[1].number is None and rows[10, "s1"].format_values[0].number is None
    types = {(r.field_class, r.canonical): r.unified_type for r in V.unified_types(t[0], t[1], ch).collect()}
    assert types["INFO", "DP"] == "Float" and types["FORMAT", "GT"] == "String"


def canonical(spark, files, fields):
    t = tables(spark, files, fields)
    return {(r.file_id, r.field_id): r.canonical for r in V.canonical_fields(t[0], t[1], V.dictionary_changes(*t)).collect()}


def test_a_field_keeps_its_name_through_time(spark):
    files = [(i, "c", 10 * i, [], "") for i in range(1, 9)] + [(20, "d", 1, [], ""), (21, None, 1, [], ""), (22, "c", None, [], "")]
    f = lambda i, name, text: field(i, 1, "INFO", name, text=text)
    fields = [
        f(1, "A", "depth"), f(2, "B", "Depth"), f(3, "C", "depth"), f(4, "D", "DEPTH"), f(5, "E", "depth"), f(8, "Z", "depth"),  # renamed four times, away in 6 and 7, back under another name
        f(4, "A", "share"), f(5, "A", "share"), f(6, "A", "Share"), f(7, "AA", "share"), f(8, "A", "third"),  # the name is used again, and once more
        *(f(i, "T", f"text {i}") for i in range(1, 9)), f(20, "A", "depth"), f(21, "B", "depth"), f(22, "C", "depth"),
    ]
    want = {(1, "A"): "A", (2, "B"): "A", (3, "C"): "A", (4, "D"): "A", (5, "E"): "A", (8, "Z"): "A", (4, "A"): "A@2", (5, "A"): "A@2", (6, "A"): "A@2", (7, "AA"): "A@2", (8, "A"): "A@3"}
    want |= {(i, "T"): "T" for i in range(1, 9)} | {(20, "A"): "A", (21, "B"): "B", (22, "C"): "C"}
    assert canonical(spark, files, fields) == want


def test_two_fields_that_come_back_are_not_one(spark):
    files = [(i, "c", i, [], "") for i in range(1, 5)]
    f = lambda i, name: field(i, 1, "INFO", name)
    assert canonical(spark, files, [f(1, "A"), f(3, "B"), f(3, "C"), f(4, "B"), f(4, "C")]) == {(1, "A"): "A", (3, "B"): "A", (3, "C"): "C", (4, "B"): "A", (4, "C"): "C"}


def test_renames_without_texts_need_the_values(spark):
    files = [(1, "c", 1, [], ""), (2, "c", 2, [], "")]
    fields = [field(1, 1, "FORMAT", "A1", text=None), field(1, 2, "FORMAT", "B1", text=None), field(2, 1, "FORMAT", "XX", text=None), field(2, 2, "FORMAT", "YY", text="")]
    row = lambda i, f, a, b: (i, f, "chr1", 5, None, "A", "T", 1.0, None, None, [1, 2], f"{a}:{b}", None, None)
    variants = [row(i, 1, 9000 + i, 1) for i in range(20)] + [row(50 + i, 2, 2, 9100 + i) for i in range(20)]
    t = tables(spark, files, fields, variants)
    assert {(r.name, r.old_name) for r in V.dictionary_changes(*t, same_text=False).collect()} == {("XX", "B1"), ("YY", "A1")}
    assert {r.change for r in V.dictionary_changes(*t).collect()} == {"added", "removed"}


def test_empty_tables(spark):
    t = tables(spark, [], [])
    ch = V.dictionary_changes(*t)
    assert ch.count() == 0 and V.unify_variants(*t, ch).count() == 0 and V.unified_types(t[0], t[1], ch).count() == 0
