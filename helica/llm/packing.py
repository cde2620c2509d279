"""Documents in containers of a fixed number of tokens."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut into words before byte pairs are merged; belongs to the vocabulary above.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CAPACITY = 8192
#: Items packed by one task; (id, size) pairs only.
ITEMS_PER_GROUP = 20_000


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The tokenizer of a file of ranks, read once in a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``n_tokens`` of the whole text, whatever its length; null and empty texts have 0. A row for each row; other columns are not read.

    ``path`` is read where the driver runs; the executors get the file from there.
    """
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["t"]]})

    kind = df.schema[key].dataType
    counted = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(count, "k string, n_tokens long")
    return counted.select(F.col("k").cast(kind).alias(key), "n_tokens")


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Container and place in it for items of 0 to ``capacity``, in the order given; and the number of containers.

    Sum of squares: with N(g) open containers that have a gap of g, each item goes
    where the sum of N(g) squared becomes least, into a new container included; of
    equal choices the one with the least gap is taken. A full container is closed.
    """
    open_ = np.zeros(capacity + 1, np.int64)  # by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, place, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            where[i], place[i] = 0, 0
            continue
        gaps = np.flatnonzero(open_[s:]) + s
        after = open_[gaps - s]
        after[gaps == s] = 0
        change = 2 * (after - open_[gaps]) + 2
        change[gaps == s] -= 1
        rest = capacity - s
        fresh = 2 * int(open_[rest]) + 1 if rest else 0
        k = int(np.argmin(change)) if len(gaps) else -1
        if k >= 0 and int(change[k]) <= fresh:
            gap = int(gaps[k])
            b = bins[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        where[i], place[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            open_[gap - s] += 1
    return where, place, max(used, int(len(sizes) > 0))


def pack(sizes: DataFrame, key: str, n_items: int, capacity: int = CAPACITY, per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """Every item in a container: ``container_id``, key, piece_no, token_start, token_end, container_start.

    An item larger than ``capacity`` is cut into full pieces, each a container of
    its own, and a rest that is packed like any other item. Items are packed in
    groups by a hash of key and size, as many as keep a group near ``per_group`` of
    the ``n_items`` (the row count of the source, which costs less than ``sizes``); a group leaves a few containers partly open, so the unused room is about
    the same share at any scale. Within a group the largest items come first.
    Items without tokens take no room and stand in the first container of their
    group. Repeated rows are items of their own, a null size counts as 0, and a null
    key is kept. Items of equal size come in the order of their keys as texts. An
    empty table has no containers. Other columns are not read. Containers are
    numbered by group.
    """
    groups = max(1, -(-n_items // per_group))
    keyed = sizes.select(F.col(key).cast("string").alias("k"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    kind = sizes.schema[key].dataType

    def arrange(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "k"], ascending=[False, True], kind="stable").reset_index(drop=True)
        n = items["n_tokens"].to_numpy(np.int64)
        full = n // capacity
        rest = n - full * capacity
        packed = np.flatnonzero((rest > 0) | (n == 0))
        order = packed[np.argsort(-rest[packed], kind="stable")]
        bins, starts, used = pack_sizes(rest[order], capacity)
        owner = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        rows = np.concatenate([order, owner])
        number = np.concatenate([full[order], piece])
        container = np.concatenate([bins, used + np.arange(len(owner))])
        length = np.concatenate([rest[order], np.full(len(owner), capacity)])
        group = int(items["g"].iloc[0]) if len(items) else 0
        return pd.DataFrame(
            {
                "container_id": (group << 32) + container,
                "k": items["k"].to_numpy()[rows],
                "piece_no": number,
                "token_start": number * capacity,
                "token_end": number * capacity + length,
                "container_start": np.concatenate([starts, np.zeros(len(owner), np.int64)]),
            }
        )

    schema = "container_id long, k string, piece_no long, token_start long, token_end long, container_start long"
    grouped = keyed.withColumn("g", F.pmod(F.xxhash64("k", "n_tokens"), F.lit(groups)))
    # An explicit number of partitions: the rows are few and small, but packing them is not, so groups must not share a task.
    return grouped.repartition(groups, "g").groupBy("g").applyInPandas(arrange, schema).withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of unused room."""
    each = packed.groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    total: Column = F.sum("used")
    return each.agg(F.count(F.lit(1)).alias("containers"), total.alias("tokens"), (1 - total / (F.count(F.lit(1)) * capacity)).alias("unused_share"), F.max("used").alias("fullest"))
