"""Schemas that drift between the versions of a source.

A version is a file. Every field of a version has a profile: class, declared type
and count, descriptive text, name, and a sketch of its values. Fields that two
consecutive versions do not share are matched as a bipartite graph; a matched
pair is a rename.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.operators.ordered import previous_row
from helica.session import cut_lineage

#: Weights of the parts of a pair's likeness.
WEIGHTS = {"text": 4.0, "type": 1.0, "count": 0.5, "values": 1.0, "name": 0.5}


def edit_likeness(a: str, b: str) -> float:
    """1 for equal names, 0 for names with nothing in common."""
    if not a or not b:
        return float(a == b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def sketch_likeness(a: list[float] | None, b: list[float] | None) -> float:
    """Likeness of two value sketches; 0.5 where either is missing."""
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 0.5
    gaps = np.abs(np.nan_to_num(np.array(a, float)) - np.nan_to_num(np.array(b, float)))
    return float(np.mean(1 / (1 + gaps)))


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the matching with the highest total; -inf forbids a pair.

    Successive shortest augmenting paths with potentials, cubic in the side. Every
    allowed pair counts as better than none, so the matching is also as large as
    possible. Ties go to the lower indexes.
    """
    n, m = score.shape
    size = n + m
    worst = np.max(np.where(np.isfinite(score), np.abs(score), 0), initial=0.0) + 1
    # Rows may go to dummy columns at a high price, forbidden pairs at a higher one.
    cost = np.full((size, size), 0.0)
    cost[:n, :m] = np.where(np.isfinite(score), worst - score, 8 * worst * size)
    cost[:n, m:] = 2 * worst * 2
    cost[n:, :m] = 0.0
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(size + 1, np.inf), np.zeros(size + 1, bool), np.zeros(size + 1, int)
        while match[j0]:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(used[1:], np.inf, low[1:])
            j1 = int(np.argmin(free)) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, size + 1)]
    return sorted((i, j) for i, j in pairs if i < n and j < m and np.isfinite(score[i, j]))


def likeness(a: dict, b: dict) -> float:
    """How alike two profiles are, as a share of the most they could be, which is less where neither has a text."""
    text = float(bool(a["text"]) and a["text"] == b["text"])
    parts = {"text": text, "type": a["type"] == b["type"], "count": a["count"] == b["count"], "values": sketch_likeness(a["sketch"], b["sketch"]), "name": edit_likeness(a["name"], b["name"])}
    most = sum(WEIGHTS.values()) - WEIGHTS["text"] * (not a["text"] and not b["text"])
    return sum(WEIGHTS[k] * v for k, v in parts.items()) / most


def match_fields(gone: list[dict], new: list[dict], same_text: bool) -> list[tuple[int, int]]:
    """Indexes of the (gone, new) pairs that are renames.

    With ``same_text`` only pairs of equal, non-empty text may match; otherwise
    pairs whose likeness reaches a half.
    """
    score = np.full((len(gone), len(new)), -np.inf)
    for i, a in enumerate(gone):
        for j, b in enumerate(new):
            alike = likeness(a, b) if not same_text or (a["text"] and a["text"] == b["text"]) else -np.inf
            if same_text or alike >= 0.5:
                score[i, j] = alike
    return best_assignment(score) if np.isfinite(score).any() else []


def squeezed(c: Column) -> Column:
    """Text without case and blanks."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


PROFILE = "struct<name:string,text:string,type:string,count:string>"
SKETCHED = "struct<name:string,text:string,type:string,count:string,sketch:array<double>>"


def field_changes(profiles: DataFrame, order: DataFrame, same_text: bool = True, sketch_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Changes of fields between each version and the one before it.

    ``profiles``: version, kind, name, text, type, count; one row a field.
    ``order``: version, previous. Result: version, kind, name, change (``added``,
    ``removed``, ``renamed`` or ``retyped``), old_name and likeness (of renames).

    Two profiles with the same kind and name are the same field. The two sides of
    a version meet in one hash aggregation on (version, kind, name), so a long
    history costs no join of versions with versions. Names on one side only are
    matched by the likeness of their profiles. With ``same_text`` the bipartite graph
    falls apart by text, so a header of thousands of fields is many small ones;
    otherwise it has all gone and new fields of a version and kind. ``sketch_of``
    gives the value sketches (version, kind, name, sketch) of the fields that have
    one to be compared with; the others are added or removed in any case. Null texts, types
    and counts are values of their own, and no null or empty text equals another.
    Of equally good matchings the one with the lower names is taken. Empty tables
    give no changes; other columns are not read.
    """
    profile = F.struct("name", "text", "type", "count").cast(PROFILE)
    later = order.where(F.col("previous").isNotNull())
    now = profiles.join(later.select("version"), "version").select("version", "kind", "name", profile.alias("now"), F.lit(None).cast(PROFILE).alias("before"))
    old = profiles.withColumnRenamed("version", "previous").join(later, "previous").select("version", "kind", "name", F.lit(None).cast(PROFILE).alias("now"), profile.alias("before"))
    sides = now.unionByName(old).groupBy("version", "kind", "name").agg(F.first("now", ignorenulls=True).alias("now"), F.first("before", ignorenulls=True).alias("before"))
    same = F.col("now.type").eqNullSafe(F.col("before.type")) & F.col("now.count").eqNullSafe(F.col("before.count"))
    kind_of = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(~same, "retyped")
    # The changes are few beside the fields, and several steps need them.
    changed = cut_lineage(sides.withColumn("change", kind_of).where(F.col("change").isNotNull()))
    retyped = changed.where(F.col("change") == "retyped").select("version", "kind", "name", "change", F.lit(None).cast("string").alias("old_name"))
    text = F.coalesce(F.col("now.text"), F.col("before.text"), F.lit(""))
    keys = ["version", "kind", "topic"]
    groups = (
        changed.where(F.col("change") != "retyped")
        .withColumn("topic", text if same_text else F.lit(""))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("now")).alias("new"), F.array_sort(F.collect_list("before")).alias("gone"))
    )
    both = (F.size("new") > 0) & (F.size("gone") > 0) & ((F.col("topic") != "") | F.lit(not same_text))
    row = lambda name, change, old: F.struct(name.alias("name"), F.lit(change).alias("change"), old.alias("old_name"))
    none = F.lit(None).cast("string")
    alone = F.concat(F.transform("new", lambda f: row(f["name"], "added", none)), F.transform("gone", lambda f: row(f["name"], "removed", none)))
    plain = groups.where(~both).select("version", "kind", F.explode(alone).alias("c")).select("version", "kind", "c.*")

    contested = cut_lineage(
        groups.where(both).join(later, "version")
        .select(*keys, F.explode(F.concat(F.transform("new", lambda f: F.struct(F.lit(True).alias("is_new"), F.col("version").alias("source"), f.alias("f"))), F.transform("gone", lambda f: F.struct(F.lit(False).alias("is_new"), F.col("previous").alias("source"), f.alias("f"))))).alias("e"))
        .select(*keys, "e.is_new", "e.source", "kind", "e.f.*")
        .select(*keys, "is_new", "source", "name", "text", "type", "count")
    )
    if sketch_of:
        fields = contested.select(F.col("source").alias("version"), "kind", "name").distinct()
        contested = contested.join(sketch_of(fields).withColumnRenamed("version", "source"), ["source", "kind", "name"], "left")
    else:
        contested = contested.withColumn("sketch", F.lit(None).cast("array<double>"))
    full = F.struct("name", "text", "type", "count", "sketch").cast(SKETCHED)
    side = lambda new: F.array_sort(F.collect_list(F.when(F.col("is_new") == new, full)))
    compared = contested.groupBy(*keys).agg(side(True).alias("new"), side(False).alias("gone"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for version, kind, new, gone in zip(batch["version"], batch["kind"], batch["new"], batch["gone"]):
                new, gone = list(new), list(gone)
                pairs = match_fields(gone, new, same_text)
                matched = {j: (gone[i]["name"], likeness(gone[i], new[j])) for i, j in pairs}
                left = {i for i, _ in pairs}
                rows += [(version, kind, f["name"], "renamed", *matched[j]) if j in matched else (version, kind, f["name"], "added", None, None) for j, f in enumerate(new)]
                rows += [(version, kind, f["name"], "removed", None, None) for i, f in enumerate(gone) if i not in left]
            yield pd.DataFrame(rows, columns=["version", "kind", "name", "change", "old_name", "likeness"])

    version_type = profiles.schema["version"].dataType.simpleString()
    found = compared.mapInPandas(match, f"version {version_type}, kind string, name string, change string, old_name string, likeness double")
    return retyped.unionByName(plain).withColumn("likeness", F.lit(None).cast("double")).unionByName(found)


def member_changes(members: DataFrame, order: DataFrame, kind: str) -> DataFrame:
    """Changes of an ordered list of names (``version``, ``members`` array) between versions.

    ``added`` and ``removed`` names, and one row ``*`` ``reordered`` where the
    names of both versions stand in another order. A name repeated within a
    version counts once, at its first place; a null list is an empty one.
    """
    clean = members.select("version", F.array_distinct(F.filter(F.coalesce("members", F.array().cast("array<string>")), lambda m: m.isNotNull())).alias("members"))
    later = order.where(F.col("previous").isNotNull())
    both = later.join(clean, "version").join(clean.select(F.col("version").alias("previous"), F.col("members").alias("old")), "previous")
    moved = F.array_intersect("members", "old") != F.array_intersect("old", "members")

    def rows(names: Column, change: str) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(change).alias("change")))

    all_changes = F.concat(
        rows(F.array_except("members", "old"), "added"),
        rows(F.array_except("old", "members"), "removed"),
        F.when(moved, rows(F.array(F.lit("*")), "reordered")).otherwise(rows(F.array().cast("array<string>"), "reordered")),
    )
    return both.select("version", F.lit(kind).alias("kind"), F.explode(all_changes).alias("c")).select("version", "kind", F.col("c.name").alias("name"), F.col("c.change").alias("change"), F.lit(None).cast("string").alias("old_name"), F.lit(None).cast("double").alias("likeness"))


def version_order(files: DataFrame, group: str, order: str, version: str) -> DataFrame:
    """``version`` and ``previous`` of each distinct version; null for the first of a group."""
    distinct = files.where(F.col(version).isNotNull()).groupBy(version).agg(F.min(F.struct(group, order)).alias("k")).select(version, f"k.{group}", f"k.{order}")
    return previous_row(distinct, group, order, version, version).select(F.col(version).alias("version"), "previous")
