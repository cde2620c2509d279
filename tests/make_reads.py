"""Reads of a fixed layout: fragments in steps over two contigs, a few unmapped ones with and without a position."""

import random

from helica.sources.sam import READ_SCHEMA, SamHeader

CONTIGS = [(f"chr{i}", 60_000_000) for i in range(1, 23)]
HEADER = SamHeader.of_contigs(CONTIGS, "coordinate")
NAMES = [n for n, _ in CONTIGS]


def row(name, flags, contig, start, mate=None, mate_start=0, tags="RG:Z:L1\tNM:i:3"):
    dice = random.Random(f"{name}{flags}")
    bases, quals = "".join(dice.choices("ACGTN", k=36)), "".join(chr(33 + dice.randrange(42)) for _ in range(36))
    ref, mate_ref = (-1 if c is None else NAMES.index(c) for c in (contig, mate))
    placed = contig is not None and not flags & 4
    end = start + 35 if placed else start
    return (name, flags, ref, contig, start, end, 60 if placed else 0, "36M" if placed else "*", mate_ref, mate, mate_start, 136 if placed else 0, bases, quals, tags)


def read_rows(pairs=1000):
    """``pairs`` pairs every 700 positions of chr9, both mates 160 apart, with every hundredth unmapped where it would lie; and two reads without a position."""
    rows = []
    for k in range(pairs):
        at = 501 + 700 * k
        one, two = (at, at + 160)
        lost = 4 if k % 100 == 42 else 0
        rows.append(row(f"frag.{k}", 65 | lost, "chr9", one, "chr9", two))
        rows.append(row(f"frag.{k}", 129 | lost, "chr9", two, "chr9", one))
    return rows + [row(f"nowhere.{x}", 4, None, 0) for x in "ab"]


def reads(spark, pairs=1000, partitions=1):
    return spark.createDataFrame(read_rows(pairs), READ_SCHEMA).coalesce(partitions)
