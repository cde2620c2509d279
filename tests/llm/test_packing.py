import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from helica.llm import packing as P


def slow(sizes, capacity):
    """Sum of squares by definition: try every choice and count all squares again."""
    gaps, out = [], []
    for s in sizes:
        if s == 0:
            out.append(0)
            continue
        options = {g: i for i, g in reversed(list(enumerate(gaps))) if g >= s}
        counts = {g: gaps.count(g) for g in range(1, capacity)}

        def total(g):
            c = dict(counts)
            if g < capacity:
                c[g] -= 1
            if 0 < g - s < capacity:
                c[g - s] += 1
            return sum(v * v for v in c.values())

        best = min(sorted([g for g in options if g < capacity]) + [capacity], key=lambda g: (total(g), g))
        if best == capacity:
            gaps.append(capacity - s)
            out.append(len(gaps) - 1)
        else:
            i = max(j for j, g in enumerate(gaps) if g == best)
            gaps[i] -= s
            out.append(("any", best))
    return [x for x in gaps]


@given(st.lists(st.integers(0, 12), max_size=40))
def test_gaps_are_those_of_the_definition(sizes):
    where, place, used = P.pack_sizes(np.array(sizes, np.int64), 12)
    fill = np.zeros(max(used, 1), np.int64)
    np.add.at(fill, where, sizes)
    assert (fill <= 12).all() and sorted((12 - fill)[: len(slow(sizes, 12))]) == sorted(slow(sizes, 12)) or not sizes
    spans: dict[int, list] = {}
    for w, p, s in zip(where, place, sizes):
        if s:
            spans.setdefault(w, []).append((p, p + s))
    for v in spans.values():
        v.sort()
        assert v[0][0] == 0 and all(a[1] == b[0] for a, b in zip(v, v[1:]))


def test_every_token_is_in_one_container(spark):
    rows = [(i, (i * 7919) % 230) for i in range(3000)] + [(9999, 1050), (None, 5), (9999, 1050), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = P.pack(df, "doc_id", len(rows), 200, 500).collect()
    by_box: dict[int, list] = {}
    for r in got:
        by_box.setdefault(r.container_id, []).append((r.container_start, r.container_start + r.token_end - r.token_start))
    for spans in by_box.values():
        spans = sorted(s for s in spans if s[1] > s[0])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[-1][1] <= 200)
    assert sum(r.token_end - r.token_start for r in got) == sum(n or 0 for _, n in rows)
    assert len([r for r in got if r.doc_id == 9999]) == 12 and len([r for r in got if r.doc_id is None]) == 1
    assert all(r.piece_no == 0 for r in got if r.doc_id not in (9999,) and (r.doc_id or 0) * 7919 % 230 <= 200)
    report = P.fill_report(P.pack(df, "doc_id", len(rows), 200, 500), 200).first()
    assert report.unused_share < 0.03 and report.fullest <= 200


def test_tokens_of_a_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 300_000), (None, "x <|endoftext|> y")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[None] > 3
    assert P.token_counts(df.limit(0), "doc_id", "text").count() == 0
    assert P.pack(P.token_counts(df.limit(0), "doc_id", "text"), "doc_id", 0).count() == 0
