from collections import Counter

from pyspark.sql import functions as F

from helica.llm import terms as T


def frame(spark, rows):
    return spark.createDataFrame(rows, "fragment_id long, index_sequence string, term string, records long")


ROWS = [(1, "aC.t", "x", 1), (1, "aC.t", "x", 1), (2, "ACNT + GG", None, None), (3, "ACNT-ACNT", None, 2), (4, "0", None, 2), (5, "", None, 2), (6, None, None, 2), (None, "GG_0", None, 2), (None, "GG_0", None, 2), (7, "+", None, 1)]


def test_counts_by_hand(spark):
    got = {r.term: (r.occurrences, r.records) for r in T.count_terms(frame(spark, ROWS), "fragment_id", T.index_terms(F.col("index_sequence"))).collect()}
    assert got == {"ACNT": (4, 3), "GG": (3, 3), None: (0, 5)}


def test_heavy_and_light_give_the_same_counts(spark):
    rows = [(i, "HOT" if i % 3 == 0 else f"T{i % 40}+HOT" if i % 7 == 0 else f"T{i % 40}", None, None) for i in range(2000)]
    want_o, want_r = Counter(), Counter()
    for _, s, _, _ in rows:
        want_o.update(s.split("+"))
        want_r.update(set(s.split("+")))
    df = frame(spark, rows).repartition(5)
    for share in (1 / 256, 0.2, 0.99):
        got = T.count_terms(df, "fragment_id", T.index_terms(F.col("index_sequence")), share).where("term is not null").collect()
        assert {r.term: r.occurrences for r in got} == want_o and {r.term: r.records for r in got} == want_r
    assert T.heavy_terms(df.select(T.index_terms(F.col("index_sequence")).alias("terms")), 0.2) == ["HOT"]


def test_marks(spark):
    rows = [(i, "COMMON", None, None) for i in range(6)] + [(100 + i, f"M{i % 32}", None, None) for i in range(96)] + [(1000, "ONCE", None, None), (1001, "TWICE", None, None), (1002, "TWICE", None, None)]
    got = {r.term: r.term_mark for r in T.mark_terms(frame(spark, rows), "fragment_id", T.index_terms(F.col("index_sequence"))).collect()}
    assert got["COMMON"] == "common" and got["ONCE"] == got["TWICE"] == "rare" and got["M0"] is None
    at_limit = [(i, "EDGE" if i < 5 else f"M{i % 19}", None, None) for i in range(100)]
    assert {r.term: r.term_mark for r in T.mark_terms(frame(spark, at_limit), "fragment_id", T.index_terms(F.col("index_sequence"))).collect()}["EDGE"] is None


def test_empty_table_and_long_terms(spark):
    assert T.mark_terms(frame(spark, []), "fragment_id", T.index_terms(F.col("index_sequence"))).count() == 0
    long = "A" * 200_000
    got = T.mark_terms(frame(spark, [(1, long + "+" + "C", None, None)]), "fragment_id", T.index_terms(F.col("index_sequence"))).collect()
    assert {len(r.term) for r in got} == {200_000, 1}


def test_repeated_records_equal_brute_force(spark):
    import random

    dice = random.Random(4)
    rows = [(dice.choice([None, 7, dice.randrange(60)]), "+".join(dice.choices(["A", "B", "C", "HOT", "HOT"], k=dice.randrange(1, 4))), None, None) for _ in range(900)]
    lists = {(r, s) if r is not None else (f"null {i}", s) for i, (r, s, _, _) in enumerate(rows)}
    occurrences, holders = Counter(), {}
    for r, s in lists:
        occurrences.update(s.split("+"))
        for t in set(s.split("+")):
            holders.setdefault(t, set()).add(r)
    got = {r.term: (r.occurrences, r.records) for r in T.count_terms(frame(spark, rows).repartition(6), "fragment_id", T.index_terms(F.col("index_sequence"))).collect()}
    assert got.pop(None) == (0, len({r for r, _ in lists}))
    assert got == {t: (n, len(holders[t])) for t, n in occurrences.items()}
