"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.operators.joins import is_bounded
from helica.session import cut_lineage

#: A term with this share of a partition's occurrences is a candidate for the heavy ones.
HEAVY_SHARE = 1 / 256
#: Heavy terms that are broadcast, and their longest length; both bound the broadcast.
MAX_HEAVY = 1024
MAX_HEAVY_CHARS = 256
#: Light terms that a task holds before it passes their counts on.
HELD_TERMS = 200_000


def index_terms(c: Column) -> Column:
    """The terms of an index sequence: upper case, ``.`` as ``N``, cut at ``+``, ``-`` and ``_``, without blanks and ``0``."""
    clean = F.translate(F.upper(F.regexp_replace(c, r"\s+", "")), ".", "N")
    return F.filter(F.split(clean, r"[+\-_]"), lambda t: (t != "") & (t != "0"))


def heavy_terms(terms: DataFrame, share: float = HEAVY_SHARE, limit: int = MAX_HEAVY) -> list[str]:
    """Terms that hold more than ``share`` of the occurrences of a partition, by a pass of local counts; the ``limit`` with most of them.

    A partition sends at most about ``1 / share`` candidates. Its table of counts is
    bounded, so a term that comes late and thin may be overlooked: then it is
    counted like any light one. Only the speed of the count depends on the list.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        total = 0
        for batch in batches:
            for row, n in batch["terms"].map(tuple).value_counts().items():
                for term in row:
                    total += n
                    if len(term) <= MAX_HEAVY_CHARS:
                        counts[term] = counts.get(term, 0) + n
            if len(counts) > 64 / share:  # bounded table: what falls below the share may go
                counts = {t: n for t, n in counts.items() if n > total * share / 4}
        kept = [(t, n) for t, n in counts.items() if n > total * share]
        yield pd.DataFrame(kept, columns=["term", "n"])

    found = terms.mapInPandas(local, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(r["term"] for r in found.orderBy(F.desc("n"), "term").limit(limit).collect())


COUNTS = "term string, occurrences long, records long"


def _local_counts(terms: DataFrame, heavy: list[str]) -> DataFrame:
    """Counts of each partition as if every row were a record: one row for each heavy term, light ones folded; ``heavy`` tells which, a null term has the number of rows."""
    index = terms.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(heavy)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = index.value
        occurrences, in_records = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        light: dict[str, list[int]] = {}
        total = 0
        table = lambda rows, heavy: pd.DataFrame([(*r, heavy) for r in rows], columns=["term", "occurrences", "records", "heavy"])
        for batch in batches:
            total += len(batch)
            for row, n in batch["terms"].map(tuple).value_counts().items():
                for term in set(row):
                    times = row.count(term) * n
                    if (i := place.get(term)) is not None:
                        occurrences[i] += times
                        in_records[i] += n
                    else:
                        entry = light.setdefault(term, [0, 0])
                        entry[0] += times
                        entry[1] += n
            if len(light) >= HELD_TERMS:
                yield table([(t, *n) for t, n in light.items()], False)
                light = {}
        yield table([(t, *n) for t, n in light.items()] + [(None, 0, total)], False)
        names = list(place)
        yield table([(names[i], int(occurrences[i]), int(in_records[i])) for i in np.flatnonzero(in_records)], True)

    return terms.mapInPandas(count, COUNTS + ", heavy boolean")


def _repetitions(listed: DataFrame) -> DataFrame:
    """What the local counts have too much, below 0: the rows of records that come more than once.

    Only the keys of records are shuffled to find those; the terms follow only for
    the few that repeat. A record's distinct lists add up, its terms count once.
    """
    keyed = listed.where(F.col("record").isNotNull())
    again = cut_lineage(keyed.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("record"))
    rows = keyed.join(F.broadcast(again) if is_bounded(again) else again, "record", "left_semi")
    lists = rows.groupBy("record", "terms").agg(F.count(F.lit(1)).alias("n"))
    each = lists.select("record", "n", F.explode(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("times")))).alias("t"))
    by_record = each.groupBy("record", "t.term").agg(F.sum((F.col("n") - 1) * F.col("t.times")).alias("occurrences"), (F.sum("n") - 1).alias("records"))
    by_term = by_record.groupBy("term").agg((-F.sum("occurrences")).alias("occurrences"), (-F.sum("records")).alias("records"))
    total = lists.groupBy("record").agg((1 - F.sum("n")).alias("records")).agg(F.sum("records").alias("records"))
    return by_term.unionByName(total.select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records")))


def count_terms(df: DataFrame, record: str, terms: Column, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``term``, ``occurrences`` and ``records`` over the whole of ``df``; and a row with a null term that has the number of records with a term.

    A record is a distinct value of ``record``; its repeated rows count once, and
    rows that differ add up. A row with a null record is a record of its own.
    Null and empty term lists hold no term. Every row is first counted where it
    lies: heavy terms in exact arrays, one row each a partition, which never meet
    the light ones; light terms are folded and shuffled by term. What repeated rows
    of a record counted too much is then taken off. Both tables are united. An
    empty table has no term. Terms may have any length. Only ``record`` and the
    columns of ``terms`` are read, so others may have any name.
    """
    listed = df.select(F.col(record).alias("record"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms")).where(F.size("terms") > 0)
    heavy = heavy_terms(listed.select("terms"), heavy_share)
    # Written once: the light and the heavy table, and what is marked from them, read the folded counts and not the rows.
    counted = _local_counts(listed.select("terms"), heavy)
    off = _repetitions(listed).withColumn("heavy", F.coalesce(F.col("term").isin(heavy) if heavy else F.lit(False), F.lit(False)))
    parts = cut_lineage(counted.unionByName(off))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

    return summed(parts.where(~F.col("heavy"))).unionByName(summed(parts.where("heavy")))


def mark_terms(df: DataFrame, record: str, terms: Column, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """Every term with its counts and ``term_mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than ``common_share`` of the records with a term, else null."""
    counts = count_terms(df, record, terms)
    share = Fraction(str(common_share)).limit_denominator(1_000_000)
    total = counts.where(F.col("term").isNull()).agg(F.sum("records")).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * share.denominator > total * share.numerator, "common")
    return counts.where(F.col("term").isNotNull()).withColumn("term_mark", mark)
