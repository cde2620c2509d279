import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helica.llm import contamination as C

VOCABULARY = [f"w{i}" for i in range(300)]
DOCS, ITEMS = "doc_id long, text string, item_id string, k int", "item_id long, suite string, passage string, answer string, doc_id long"


def test_words():
    text = "\\emph{The} Rate~\\cite[p. 2]{key1998a,b} is 21.44\\% of \\textbf{x_2}, % note\nSection~\\ref{sec:one} Ärger \\begin{align*} a"
    assert C.words(text) == ["the", "rate", "is", "21", "44", "of", "x", "2", "note", "section", "ärger", "a"]
    assert C.words(None) == C.words("") == []


@given(st.integers(12, 90), st.data())
def test_any_twelve_words_lie_in_one_passage(n, data):
    at = data.draw(st.integers(0, n - 12))
    assert any(s <= at and at + 12 <= s + C.WINDOW for s in C.starts(n))


def test_runs_of_known_words():
    ids = np.array([1, 1, 0, 2, 2, 2, 0, 3])
    assert np.flatnonzero(C.in_runs(ids > 0, 3)).tolist() == [3, 4, 5]
    assert C.in_runs(ids > 0, 1).tolist() == (ids > 0).tolist() and C.in_runs(np.zeros(0, bool), 3).tolist() == []


@given(st.lists(st.integers(0, 4), min_size=24, max_size=24), st.integers(1, 12))
def test_the_gate_holds_the_rarest_term_of_every_run(row, length):
    idf = np.array([0, 0.1, 3, 2, 1])
    gate = C.run_gate(np.array([row], np.int32), idf, length)
    for s in range(24 - length + 1):
        part = np.array(row[s : s + length], np.int32)
        if part.all():
            assert len(gate.hits(part, part > 0)[0])


def test_a_run_is_counted_over_the_borders_of_passages(spark):
    passage = [f"v{i}" for i in range(90)]
    docs = [(1, " ".join(["a"] * 7 + passage[5:80] + ["b"] * 50 + passage), None, None)]
    items = [(1, "s", " ".join(passage), "v3", 1)]
    (r,) = C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert r.longest_run == 90 and r.common_words == 24 and r.answered


@given(st.lists(st.integers(0, 3), min_size=24, max_size=24), st.lists(st.integers(0, 3), min_size=24, max_size=24))
def test_word_comparisons_equal_slow_ones(a, b):
    x, y = np.array([a]), np.array([b])
    run = max((n for i in range(24) for j in range(24) for n in range(25) if i + n <= 24 and j + n <= 24 and n and a[i : i + n] == b[j : j + n] and all(a[i : i + n])), default=0)
    got, i, j = (int(v[0]) for v in C.longest_runs(x, y))
    assert got == run and (not run or a[i : i + run] == b[j : j + run])
    t = [[0] * 25 for _ in range(25)]
    for i in range(24):
        for j in range(24):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] and a[i] else max(t[i][j + 1], t[i + 1][j])
    assert C.common_subsequence(x, y)[0] == t[24][24]


def plant(seed=3, n_docs=150, n_items=20):
    """Texts of random words, some with stretches of 8 to 40 words of an item."""
    dice = random.Random(seed)
    items = [(i, "s", " ".join(dice.choices(VOCABULARY, k=dice.randrange(30, 90))), f"answer{i}", 0) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = dice.choices(VOCABULARY + [f"other{i}" for i in range(2000)], k=dice.randrange(5, 400))
        for _ in range(dice.choice([0, 1, 1, 2])):
            p = items[dice.randrange(n_items)][2].split()
            n = dice.choice([8, 11, 12, 13, 20, 40])
            a, at = dice.randrange(max(1, len(p) - n)), dice.randrange(len(w))
            w[at:at] = p[a : a + n]
        docs.append((d, ", ".join(w).upper(), None, None))
    return docs, items


def brute(docs, items, n=12):
    out = set()
    for d, t, *_ in docs:
        w = C.words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, _, p, *_ in items:
            q = C.words(p)
            if any(tuple(q[j : j + n]) in grams for j in range(len(q) - n + 1)):
                out.add((d, i))
    return out


def test_found_pairs_equal_brute_force(spark):
    docs, items = plant()
    want = brute(docs, items)
    got = C.find_leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    assert len(want) > 40 and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.longest_run >= 12 for r in got)


def test_without_a_threshold_the_search_is_exact(spark):
    docs, items = plant(11, 80, 12)
    got = C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_cosine=-2, rank=4).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = plant(4, 60, 9)
    monkeypatch.setattr(C, "WORDS_PER_BLOCK", 200)
    got = C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)


def test_paraphrases_need_order_and_answer(spark):
    dice = random.Random(8)
    passage = dice.sample(VOCABULARY, 60)
    changed = [f"new{i}" if i % 5 == 4 else w for i, w in enumerate(passage)]
    filler = [f"f{i}" for i in range(100)]
    docs = [(1, " ".join(filler + changed + ["fortytwo"] + filler), None, None), (2, " ".join(filler + changed + filler), None, None), (3, " ".join(sorted(passage)) + " fortytwo", None, None), (4, " ".join(passage), None, None)]
    items = [(7, "s", " ".join(passage), "fortytwo", 1)] + [(8 + i, "s", " ".join(dice.sample(VOCABULARY, 60)), "no", 1) for i in range(5)]
    got = C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrase=True).collect()
    assert {(r.doc_id, r.item_id, r.answered) for r in got} == {(1, 7, True), (4, 7, False)}
    assert C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).count() == 1


def test_paraphrases_come_besides_all_verbatim_leaks(spark):
    """Twelve words of an item amid twelve heavier words of other items, which weigh in the search for paraphrases only."""
    passage = VOCABULARY[:24]
    others = [f"rare{i}" for i in range(600)]
    items = [(1, "s", " ".join(passage), "no", 1)] + [(2 + i, "s", " ".join(others[30 * i : 30 * i + 30]), "no", 1) for i in range(20)]
    # Every item word of the text stands beside words of no item, but the run.
    around = [w for i in range(300) for w in (others[37 * i % 600], f"x{i}")]
    docs = [(1, " ".join(around[:300] + passage[6:18] + ["x"] + around[300:]), None, None)] + [(i, " ".join(passage), None, None) for i in range(2, 40)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    exact = {(r.doc_id, r.item_id) for r in C.find_leaks(d, i).collect()}
    assert (1, 1) in exact and len(exact) == 39
    assert exact == {(r.doc_id, r.item_id) for r in C.find_leaks(d, i, paraphrase=True).collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=48, max_size=48), st.lists(st.integers(0, 3), min_size=48, max_size=48), st.integers(8, 24))
def test_stretches_of_regions_equal_slow_ones(a, b, enough):
    x, y = np.array([a]), np.array([b])
    slow = max(C.common_subsequence(x[:, i : i + 24], y[:, j : j + 24])[0] for i in range(25) for j in range(25))
    got = C.common_anywhere(x, y, enough)[0]
    assert (got >= enough) == (slow >= enough) and got <= slow


def test_paraphrases_do_not_depend_on_their_place(spark):
    """Every offset of the text against the passages of it and of the item."""
    dice = random.Random(8)
    passage = dice.sample(VOCABULARY, 60)
    changed = [f"new{i}" if i % 5 == 4 else w for i, w in enumerate(passage)]
    third = [f"new{i}" if i % 3 == 2 else w for i, w in enumerate(passage[18:42])]
    filler = [f"f{i}" for i in range(112)]
    docs = [(100 * k + n, " ".join(filler[:n] + text + ["fortytwo"] + filler), None, None) for k, text in enumerate((changed, third)) for n in range(100, 112)]
    items = [(7, "s", " ".join(passage), "fortytwo", 1)] + [(8 + i, "s", " ".join(dice.sample(VOCABULARY, 60)), "no", 1) for i in range(5)]
    got = C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrase=True).collect()
    assert sorted((r.doc_id, r.item_id, r.answered) for r in got) == sorted((d[0], 7, True) for d in docs)
    assert all(r.common_words >= 16 for r in got)


def test_recall_of_planted_paraphrases(spark):
    """Stretches of 24 to 60 words with every third to fifth replaced by a word of another item, anywhere in texts of common words."""
    dice = random.Random(15)
    common = [f"c{i}" for i in range(60)]
    passages = [[dice.choice(common) if dice.random() < 0.4 else f"t{dice.randrange(900)}" for _ in range(dice.randrange(60, 120))] for _ in range(40)]
    items = [(i, "s", " ".join(p), f"answer{i}", 0) for i, p in enumerate(passages)]
    docs, want = [], set()
    for d in range(300):
        i, n, every = dice.randrange(40), dice.randrange(24, 61), dice.choice([3, 4, 5])
        at = dice.randrange(len(passages[i]) - n + 1)
        part = [dice.choice(dice.choice(passages)) if k % every == every - 1 else w for k, w in enumerate(passages[i][at : at + n])]
        around = lambda k: [dice.choice(common) if dice.random() < 0.6 else f"z{dice.randrange(3000)}" for _ in range(k)]
        docs.append((d, " ".join(around(dice.randrange(80)) + part + [f"answer{i}"] + around(dice.randrange(80))), None, None))
        want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in C.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrase=True).collect()}
    print(f"recall of paraphrases: {len(got & want)} of {len(want)}")
    assert len(got & want) >= 0.9 * len(want)


def test_nulls_empty_and_long_texts(spark):
    p = " ".join(VOCABULARY[:40])
    docs = [(None, p, None, None), (1, None, None, None), (2, "", None, None), (2**60 + 1, "x " * 300_000 + p, None, None), (2**60 + 1, "x " * 300_000 + p, None, None)]
    items = [(1, None, p, None, None), (2, "s", None, "a", 1), (3, "s", "", "a", 1), (4, "s", "too short", "a", 1), (None, "s", p, "a", 1)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted(((r.doc_id, r.item_id) for r in C.find_leaks(d, i).collect()), key=str)
    assert got == sorted([(x, y) for x in (None, 2**60 + 1, 2**60 + 1) for y in (1, None)], key=str)
    assert C.find_leaks(d.limit(0), i).count() == 0 and C.find_leaks(d, i.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.find_leaks(d, i, min_words=13)
