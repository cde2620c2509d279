import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from helica.llm import splitting as S

FILES = "bam_id long, file_size long, granularity int, overlap_records int, block long"
OFFSETS = "bam_id long, record_no int, virtual_offset long, record_bytes int, start long"


@given(st.lists(st.integers(1, 400), max_size=20), st.integers(1, 500), st.integers(1, 60))
def test_parts_cover_all_within_the_limit(inner, n, limit):
    marks = np.array(sorted({0, *(i for i in inner if i < n)}))
    parts = sorted(S.bisect(marks, 0, n, limit))
    assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(0 < b - a <= limit for a, b, _ in parts)
    for a, b, inside in parts:
        assert inside == (a not in marks)


def test_cuts_prefer_the_strongest_boundary_near_the_middle():
    assert S.bisect(np.array([0, 30, 45, 90]), 0, 100, 60) == [(0, 45, False), (45, 100, False)]
    assert S.cut_of(np.array([40, 60]), 0, 100, 60) == (40, True)
    assert S.cut_of(np.array([30, 45, 70, 90]), 0, 100, 60, np.array([1, 1, 2, 9])) == (70, True)
    assert S.bisect(np.array([0]), 0, 9, 5) == [(0, 4, False), (4, 9, True)]


def test_no_slivers():
    assert S.bisect(np.array([0, 1]), 0, 10_000, 2500) == [(0, 2500, False), (2500, 5000, True), (5000, 7500, True), (7500, 10_000, True)]
    # Outside the middle half a boundary is taken where no further piece comes of it.
    assert S.bisect(np.array([0, 10]), 0, 100, 95) == [(0, 10, False), (10, 100, False)]
    assert S.bisect(np.array([0, 10]), 0, 100, 80) == [(0, 50, False), (50, 100, True)]


def data(seed=1, n_files=12):
    dice = random.Random(seed)
    files, rows, truth = [], [], {}
    for b in range(n_files):
        offsets, address = [], 0
        for _ in range(dice.randrange(1, 12)):
            inside = 0
            for _ in range(dice.choice([1, 3, 9, 40])):
                offsets.append(address << 16 | inside)
                inside += dice.randrange(40, 200)
            address += dice.randrange(100, 60_000) << dice.choice([0, 0, 9])
        size = address + 500
        limit, overlap = dice.choice([8, 16, 30]), dice.choice([0, 1, 4, None, 100])
        files.append((b, size, limit, overlap, 7))
        both = [(b, i, o, 100, 1) for i, o in enumerate(offsets)] + [(b, None, size << 16, None, 1)]
        both += dice.sample(both, len(both) // 3)
        dice.shuffle(both)
        rows += both
        truth[b] = (offsets, limit, min(overlap or 0, limit - 1))
    return files, rows, truth


def brute(truth):
    out = set()
    for b, (offsets, limit, overlap) in truth.items():
        if len(offsets) <= limit:
            continue
        marks = np.array([i for i, o in enumerate(offsets) if i == 0 or o >> 16 != offsets[i - 1] >> 16])
        for a, e, inside in S.bisect(marks, 0, len(offsets), limit - overlap):
            first = max(0, a - overlap)
            out.add((b, first, e, e - first, a - first, inside, offsets[first], offsets[e - 1], offsets[a]))
    return out


def test_pieces_equal_brute_force_at_any_task_size(spark):
    files, rows, truth = data()
    f, o = spark.createDataFrame(files, FILES), spark.createDataFrame(rows, OFFSETS).repartition(5)
    for max_blocks in (1 << 20, 3, 1):
        got = [tuple(r) for r in S.split_items(f, o, max_blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(truth)
    assert all(r[3] <= truth[r[0]][1] for r in got)


def test_oversized_items(spark):
    files, rows, truth = data(2)
    got = {tuple(r) for r in S.oversized_items(spark.createDataFrame(files, FILES), spark.createDataFrame(rows, OFFSETS)).collect()}
    want = set()
    for b, (offsets, limit, _) in truth.items():
        if len(offsets) > limit:
            want.add((b, offsets[0], "file"))
            blocks: dict[int, list[int]] = {}
            for x in offsets:
                blocks.setdefault(x >> 16, []).append(x)
            want |= {(b, v[0], "block") for v in blocks.values() if len(v) > limit}
    assert got == want


def test_defaults_nulls_and_empty_tables(spark):
    files = [(1, 10**9, None, None, 0), (2, 10**9, 0, -3, 0), (3, None, 2, None, 0), (None, 5, 5, 5, 5)]
    rows = [(1, 0, i << 16, 1, 0) for i in range(4097)] + [(2, 0, i << 16, 1, 0) for i in range(4096)] + [(3, 0, i, 9, 0) for i in range(3)] + [(3, None, 99 << 16, None, 0), (None, 1, 1, 1, 1), (1, 1, None, 1, 1), (9, 1, 5, 1, 1)]
    f, o = spark.createDataFrame(files, FILES), spark.createDataFrame(rows, OFFSETS)
    assert {(r.bam_id, r.n_records) for r in S.split_items(f, o).collect()} == {(1, 2048), (1, 2049), (3, 1), (3, 2)}
    assert S.split_items(f.limit(0), o.limit(0)).count() == 0 and S.oversized_items(f.limit(0), o.limit(0)).count() == 0
    assert S.split_items(f.limit(0), o).count() == 2
