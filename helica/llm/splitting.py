"""Items that are too large, cut into pieces at natural boundaries with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helica.operators.joins import keyed_join
from helica.operators.ordered import running_start
from helica.session import cut_lineage

DEFAULT_GRANULARITY = 4096
#: Blocks of one item that a task may hold at once; larger items are first bisected as a table.
MAX_BLOCKS_PER_TASK = 1 << 20
#: Compressed bytes of a file whose records are put in order by one task.
CHUNK_SHIFT = 24


def bisect(boundaries: np.ndarray, low: int, high: int, limit: int, strengths: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """Cut ``[low, high)`` into parts of at most ``limit``: (start, end, start is inside a block).

    A part that is too large is cut at the strongest boundary near its midpoint
    (``cut_of``); then both halves are cut in the same way. ``boundaries`` are
    sorted; all are equally strong unless ``strengths`` tells otherwise.
    """
    parts, todo = [], [(low, high, False)]
    while todo:
        a, b, inside = todo.pop()
        if b - a <= limit:
            parts.append((a, b, inside))
            continue
        cut, at_boundary = cut_of(boundaries, a, b, limit, strengths)
        todo += [(cut, b, not at_boundary), (a, cut, inside)]
    return parts


def cut_of(boundaries: np.ndarray, a: int, b: int, limit: int, strengths: np.ndarray | None = None) -> tuple[int, bool]:
    """Where ``[a, b)`` is cut, and whether that is a boundary.

    Boundaries near the midpoint are those in the middle half; of them the
    strongest counts, then the nearest, then the lower. Where the middle half has
    none, one further out is taken if both sides are then within the limit, so that
    it costs no further piece; otherwise the cut is inside a block, at the midpoint.
    """
    edge = (b - a) // 4
    i, j = np.searchsorted(boundaries, [a + edge, b - edge], "left")
    j = np.searchsorted(boundaries, b - edge, "right")
    i += int(i < len(boundaries) and boundaries[i] == a)
    j -= int(j > i and boundaries[j - 1] == b)
    if i >= j:
        i, j = np.searchsorted(boundaries, max(a + 1, b - limit), "left"), np.searchsorted(boundaries, min(b - 1, a + limit), "right")
    if i >= j:
        return (a + b) // 2, False
    near = boundaries[i:j]
    order = np.lexsort((near, np.abs(2 * near - a - b), np.zeros(j - i) if strengths is None else -strengths[i:j]))
    return int(near[order[0]]), True


def clean_records(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """The records of each file: distinct offsets without the closing entry, with the file's ``limit`` and ``overlap``.

    The closing entry stands at ``file_size << 16``; in files that are not in
    ``files`` it is an offset that never has a size. Rows with a null file or
    offset are no records. A null, zero or negative granularity is the default,
    a null or negative overlap none; an overlap is less than the granularity.
    """
    keys = offsets.where(F.col("bam_id").isNotNull() & F.col("virtual_offset").isNotNull())
    distinct = keys.groupBy("bam_id", "virtual_offset").agg(F.max("record_bytes").alias("record_bytes"))
    sizes = files.where(F.col("bam_id").isNotNull()).groupBy("bam_id").agg(F.max("file_size").alias("file_size"), F.max("granularity").alias("granularity"), F.max("overlap_records").alias("overlap"))
    known = keyed_join(distinct, sizes, ["bam_id"], "left")
    closing = F.when(F.col("file_size").isNotNull(), F.col("virtual_offset") == F.shiftleft("file_size", 16)).otherwise(F.col("record_bytes").isNull())
    limit = F.when(F.col("granularity") > 0, F.col("granularity")).otherwise(F.lit(DEFAULT_GRANULARITY)).cast("long")
    overlap = F.least(F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)).cast("long"), limit - 1)
    return known.where(~closing).select("bam_id", "virtual_offset", F.shiftrightunsigned("virtual_offset", 16).alias("block"), limit.alias("limit"), overlap.alias("overlap"))


def numbered_blocks(records: DataFrame) -> DataFrame:
    """Blocks of the files with more records than their limit: ``start`` is the number of records before the block.

    A file of any size is put in order chunk by chunk of its compressed bytes.
    """
    blocks = records.groupBy("bam_id", "block", "limit", "overlap").agg(F.count(F.lit(1)).alias("n_records"), F.min("virtual_offset").alias("first_offset"))
    blocks = blocks.withColumn("chunk", F.shiftright("block", CHUNK_SHIFT))
    # Written once: totals come from the blocks, so the records are shuffled for them alone.
    blocks = cut_lineage(blocks)
    totals = blocks.groupBy("bam_id").agg(F.sum("n_records").alias("total"), F.first("limit").alias("_limit")).where(F.col("total") > F.col("_limit")).drop("_limit")
    return cut_lineage(running_start(keyed_join(blocks, totals, ["bam_id"], "inner"), ["bam_id"], "chunk", ["block"], F.col("n_records")))


SEGMENT = ["bam_id", "limit", "overlap", "low", "high", "inside"]


def _segments(blocks: DataFrame, max_blocks: int) -> DataFrame:
    """Stretches of the files that each hold at most ``max_blocks`` blocks, with their boundaries.

    One row a stretch: bam_id, limit, overlap, low, high, inside, boundaries.
    Files with more blocks are bisected level by level, each level one
    aggregation over the blocks, by the rule of ``cut_of``. Every block carries its
    stretch, and the cuts, one for each stretch, are joined to it with salt, so a
    file with most of the blocks is spread over many tasks.
    """
    open_ = blocks.select("bam_id", "limit", "overlap", F.lit(0).cast("long").alias("low"), F.col("total").alias("high"), F.lit(False).alias("inside"), "start")
    done = None
    step, part = F.col("start"), F.col("high") - F.col("low")
    edge = F.floor(part / 4)
    own = F.col("limit") - F.col("overlap")
    near = (step >= F.col("low") + edge) & (step <= F.col("high") - edge)
    within = (step > F.col("low")) & (step < F.col("high"))
    fits = (step >= F.col("high") - own) & (step <= F.col("low") + own)
    rank = F.when(within & near, F.struct(F.lit(0).alias("far"), F.abs(step * 2 - F.col("low") - F.col("high")).alias("gap"), step.alias("at"))).when(within & fits, F.struct(F.lit(1).alias("far"), F.abs(step * 2 - F.col("low") - F.col("high")).alias("gap"), step.alias("at")))
    while True:
        sizes = cut_lineage(open_.groupBy(*SEGMENT).agg(F.count("start").alias("n_blocks"), F.min(rank).alias("best")))
        too_many = (F.col("n_blocks") > max_blocks) & (part > own)
        if not sizes.where(too_many).limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        cuts = sizes.select(*SEGMENT, F.when(too_many, F.coalesce("best.at", F.shiftright(F.col("low") + F.col("high"), 1))).alias("cut"), F.col("best").isNull().alias("blind"))
        placed = keyed_join(open_, cuts, SEGMENT, "inner")
        small = placed.where(F.col("cut").isNull()).select(*SEGMENT, "start")
        done = small if done is None else done.unionByName(small)
        upper = F.coalesce(step >= F.col("cut"), F.lit(False))
        # A row without a block stands for each upper half, so that a half in which no block starts is not lost.
        bare = cuts.where(F.col("cut").isNotNull()).select("bam_id", "limit", "overlap", F.col("cut").alias("low"), "high", F.col("blind").alias("inside"), F.lit(None).cast("long").alias("start"))
        open_ = cut_lineage(
            placed.where(F.col("cut").isNotNull()).select(
                "bam_id", "limit", "overlap", F.when(upper, F.col("cut")).otherwise(F.col("low")).alias("low"), F.when(upper, F.col("high")).otherwise(F.col("cut")).alias("high"),
                F.when(upper, F.col("blind")).otherwise(F.col("inside")).alias("inside"), "start",
            ).unionByName(bare)
        )


def _stretches(blocks: DataFrame, max_blocks: int) -> DataFrame:
    """The stretches with their boundaries as arrays; one in which no block starts has an empty array."""
    return _segments(blocks, max_blocks).groupBy(*SEGMENT).agg(F.array_sort(F.collect_list("start")).alias("boundaries"))


def cut_parts(blocks: DataFrame, max_blocks: int = MAX_BLOCKS_PER_TASK) -> DataFrame:
    """Own parts of the pieces of each oversized file: bam_id, limit, overlap, own_first, own_end, inside_block."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for a, b, inside in bisect(np.asarray(r.boundaries, np.int64), r.low, r.high, r.limit - r.overlap):
                    rows.append((r.bam_id, r.limit, r.overlap, a, b, bool(r.inside) if a == r.low else inside))
            yield pd.DataFrame(rows, columns=["bam_id", "limit", "overlap", "own_first", "own_end", "inside_block"])

    return _stretches(blocks, max_blocks).mapInPandas(cut, "bam_id long, limit long, overlap long, own_first long, own_end long, inside_block boolean")


def split_items(files: DataFrame, offsets: DataFrame, max_blocks: int = MAX_BLOCKS_PER_TASK) -> DataFrame:
    """The pieces of every file with more records than its granularity.

    Columns: bam_id, piece_first and piece_end (record numbers from 0, the end
    exclusive), n_records, n_overlap (records shared with the piece before),
    inside_block (the cut before the piece is inside a block), first_offset,
    last_offset, own_offset (first record that is not shared). A piece has at
    most ``granularity`` records. Files within the limit have no row; an empty
    table gives an empty result; repeated and unordered rows change nothing; other
    columns are not read. Of two boundaries equally near a midpoint the lower is taken.
    """
    blocks = numbered_blocks(clean_records(files, offsets))
    first = F.greatest(F.col("own_first") - F.col("overlap"), F.lit(0))
    pieces = cut_parts(blocks, max_blocks).withColumn("piece_first", first)
    ends = F.array(F.col("piece_first"), F.col("own_first"), F.col("own_end") - 1)
    wanted = pieces.withColumn("ordinal", F.explode(F.array_distinct(ends)))
    # Records and blocks meet in cells of ``limit`` records, so a file with many of both is not one group.
    cell = lambda c: F.floor(c / F.col("limit"))
    spans = blocks.select("bam_id", "block", "start", "n_records", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n_records") - 1))).alias("cell"))
    placed = wanted.withColumn("cell", cell(F.col("ordinal"))).join(spans, ["bam_id", "cell"]).where((F.col("ordinal") >= F.col("start")) & (F.col("ordinal") < F.col("start") + F.col("n_records")))
    placed = cut_lineage(placed.withColumn("rank", F.col("ordinal") - F.col("start")).drop("cell", "start", "n_records"))
    # Only the blocks that hold an end of a piece are read again record by record.
    ended = placed.select("bam_id", "block").distinct()
    raw = offsets.where(F.col("virtual_offset").isNotNull()).select("bam_id", "virtual_offset", F.shiftrightunsigned("virtual_offset", 16).alias("block"))
    inner = keyed_join(raw, ended, ["bam_id", "block"], "inner").groupBy("bam_id", "block", "virtual_offset").agg(F.lit(1))
    numbered = inner.select("bam_id", "block", "virtual_offset", F.expr("row_number() over (partition by bam_id, block order by virtual_offset) - 1").cast("long").alias("rank"))
    found = placed.join(numbered, ["bam_id", "block", "rank"])

    def offset_at(name: str):
        return F.max(F.when(F.col("ordinal") == F.col(name), F.col("virtual_offset")))

    return (
        found.withColumn("own_last", F.col("own_end") - 1)
        .groupBy("bam_id", "piece_first", "own_first", "own_end", "inside_block")
        .agg(offset_at("piece_first").alias("first_offset"), offset_at("own_first").alias("own_offset"), offset_at("own_last").alias("last_offset"))
        .select("bam_id", "piece_first", F.col("own_end").alias("piece_end"), (F.col("own_end") - F.col("piece_first")).alias("n_records"), (F.col("own_first") - F.col("piece_first")).alias("n_overlap"), "inside_block", "first_offset", "last_offset", "own_offset")
    )


def oversized_items(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """bam_id, virtual_offset, item_level of the files and blocks that had to be cut for their size.

    A file that was cut gives ``file``. A block that a cut runs through gives
    ``block`` if it alone has more records than the granularity.
    """
    blocks = numbered_blocks(clean_records(files, offsets))
    parts = cut_parts(blocks)
    inner = parts.where("inside_block").select("bam_id", "own_first", F.floor(F.col("own_first") / F.col("limit")).alias("cell"))
    whole = blocks.where(F.col("n_records") > F.col("limit")).select("bam_id", "first_offset", "start", (F.col("start") + F.col("n_records")).alias("end"), "limit")
    # Cuts and blocks meet in cells of ``limit`` records, so a file with many of both is not one group.
    cells = whole.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / F.col("limit")), F.floor(F.col("end") / F.col("limit")))))
    hit = cells.join(inner, ["bam_id", "cell"]).where((F.col("own_first") > F.col("start")) & (F.col("own_first") < F.col("end")))
    of_blocks = hit.groupBy("bam_id", "first_offset").agg(F.lit("block").alias("item_level"))
    of_files = parts.where(F.col("own_first") == 0).select("bam_id").join(blocks.where(F.col("start") == 0).select("bam_id", "first_offset"), "bam_id").withColumn("item_level", F.lit("file"))
    return of_files.unionByName(of_blocks).withColumnRenamed("first_offset", "virtual_offset").select("bam_id", "virtual_offset", "item_level")
