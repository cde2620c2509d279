"""Base qualities in several notations as Phred+33 text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.operators.clashes import set_aside
from helica.operators.joins import keyed_join
from helica.operators.units import Reading, convert, resolve_units

MAX_SCORE = 41
#: How far, as a logarithm of a ratio of probabilities, any value of a read may miss a whole score: a quarter of a score, as much as rounding to two digits does.
MAX_LOG_RESIDUAL = math.log(10) / 40
NEW = {"unit", "unit_source", "unit_ambiguous", "quality_phred33", "lane_cut", "unit_below", "unit_from", "_values", "_claim", "_misses", "_fits", "_salt"}


def stated_units(runs: DataFrame, key: str = "run_id", label: str = "quality_encoding", note: str = "run_note") -> DataFrame:
    """What each run says about its scale: ``unit_below`` for lanes under ``lane_cut``, ``unit_from`` for the others.

    A label comes before a note. Numbers in a note count only next to words about
    an offset. Runs that say nothing, and null labels and notes, give null.
    """
    text = F.lower(F.coalesce(F.col(label), F.lit("")))
    from_label = (
        F.when(text.rlike(r"\blog"), "log10")
        .when(text.rlike(r"prob|\bp\(e"), "errprob")
        .when(text.rlike(r"numeric|decimal|\bnumbers?\b"), "decimal")
        .when(text.rlike(r"(phred|offset|ascii)\s*(\+|plus)?\s*33|sanger|illumina[ -]?1\.[89]"), "phred33")
        .when(text.rlike(r"(phred|offset|ascii)\s*(\+|plus)?\s*64|illumina"), "phred64")
    )
    said = F.lower(F.coalesce(F.col(note), F.lit("")))
    up_to = r"offset (33|64) up to lane (\d+)\W+from lane (\d+) on,? (?:ascii )?offset (33|64)"
    below = r"lanes? below (\d+) (?:carry|carries|use|have) (?:ascii )?offset (33|64)\W+lanes? (\d+) and above (?:ascii )?offset (33|64)"
    by_lane = F.when(said.rlike(up_to), F.struct(F.regexp_extract(said, up_to, 3).alias("cut"), F.regexp_extract(said, up_to, 1).alias("low"), F.regexp_extract(said, up_to, 4).alias("high"))).when(
        said.rlike(below), F.struct(F.regexp_extract(said, below, 3).alias("cut"), F.regexp_extract(said, below, 2).alias("low"), F.regexp_extract(said, below, 4).alias("high"))
    )
    from_note = (
        F.when(said.rlike(r"logarithm|log10"), "log10")
        .when(said.rlike(r"error probabilit|p\(err"), "errprob")
        .when(said.rlike(r"decimal|phred numbers|numeric"), "decimal")
        .when(said.rlike(r"(offset|phred (plus|\+)|subtract) ?33|exclamation mark|sanger|illumina 1\.[89]"), "phred33")
        .when(said.rlike(r"(offset|phred (plus|\+)|subtract) ?64|at sign|illumina 1\.[3-7]"), "phred64")
    )
    whole = F.coalesce(from_label, F.when(by_lane.isNull(), from_note))
    return runs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(whole.alias("whole"), by_lane.alias("by_lane"))).alias("s")).select(
        key,
        F.when(F.col("s.whole").isNull(), F.col("s.by_lane.cut").cast("int")).alias("lane_cut"),
        F.coalesce("s.whole", F.concat(F.lit("phred"), F.col("s.by_lane.low"))).alias("unit_below"),
        F.coalesce("s.whole", F.concat(F.lit("phred"), F.col("s.by_lane.high"))).alias("unit_from"),
    )


def _values(quality: Column) -> Column:
    return F.transform(F.split(F.trim(quality), r"[;,\s]+"), lambda v: v.try_cast("double"))


def _beyond(excess: Column) -> Column:
    """The residual of a bound that is passed by the ratio ``exp(excess)``: more than any reading may have, and the more the further."""
    return F.when(excess > 0, 1.0 + excess).otherwise(0.0)


def quality_readings(values: Column, quality: Column, bases: Column) -> list[Reading]:
    """The readings of a quality, with the log residual of three identities between the columns.

    A read has as many scores as bases; a score ``Q`` is a whole number from 0
    to 41; and ``Q = -10 log10 P``. For each combination of notation and offset the
    residual is the sum of: the log ratio of scores to bases (any miss is one
    too many); the log ratio by which the highest score passes 41, and the lowest
    falls below 0; and of all values the largest log ratio between the probability
    that stands there and that of the next whole score. So it does not depend on
    the length of a read. Where the bases are null the first is left out. A reading
    is impossible (null) where values are no numbers, or have no probability.
    """
    step = math.log(10) / 10
    n_bases = F.length(bases)

    def counted(n: Column) -> Column:
        return F.coalesce(_beyond(F.abs(F.ln((n + 1) / (n_bases + 1)))), F.lit(0.0))

    chars = F.split(quality, "")
    highest, lowest = F.ascii(F.array_max(chars)), F.ascii(F.array_min(chars))

    def text(offset: int) -> Column:
        ascii_only = F.coalesce(~quality.rlike(r"[^\x00-\x7f]"), F.lit(False))
        over, under = F.ln((highest - offset + 1) / (MAX_SCORE + 1)), F.log1p(F.lit(offset) - lowest)
        range_of = F.when(quality == "", 0.0).otherwise(_beyond(F.when(highest >= offset, over).otherwise(0.0)) + _beyond(F.when(lowest < offset, under).otherwise(0.0)))
        return F.when(ascii_only, counted(F.length(quality)) + range_of)

    def numbers(score, miss, possible) -> Column:
        """The count, and of all values the largest miss; null as soon as one is impossible."""
        usable = (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(possible(v), F.lit(False)))

        def one(v: Column) -> Column:
            q = F.round(score(v))
            return miss(v, q) + _beyond(F.when(q > MAX_SCORE, F.ln(q / MAX_SCORE)).otherwise(0.0))

        return F.when(usable, counted(F.size(values)) + F.aggregate(values, F.lit(0.0), lambda a, v: F.greatest(a, one(v))))

    def text_of(score) -> Column:
        return F.array_join(F.transform(values, lambda v: F.char(F.round(score(v)).cast("int") + 33)), "")

    minus_ten = lambda v: -10 * F.log10(v)
    # A written score is whole, so a part of one is missed both as a score and by the ratio to the next, which has no bound near 0.
    scores = lambda v, q: F.when(v == q, 0.0).when(q == 0, 1.0 + F.abs(v)).otherwise(F.greatest(F.abs(F.ln(v / q)), F.abs(v - q) * step))
    return [
        Reading("phred33", text(33), quality),
        Reading("phred64", text(64), F.translate(quality, "".join(map(chr, range(64, 127))), "".join(map(chr, range(33, 96))))),
        Reading("decimal", numbers(lambda v: v, scores, lambda v: v >= 0), text_of(lambda v: v)),
        Reading("errprob", numbers(minus_ten, lambda v, q: F.abs(F.ln(v) + q * step), lambda v: (v > 0) & (v <= 1)), text_of(minus_ten)),
        Reading("log10", numbers(lambda v: -10 * v, lambda v, q: F.abs(v * 10 + q) * step, lambda v: v <= 0), text_of(lambda v: -10 * v)),
    ]


def unify_qualities(fragments: DataFrame, runs: DataFrame, quality: str = "quality", bases: str = "seq_bases", lane: str = "lane", key: str = "run_id") -> DataFrame:
    """Every fragment row with ``unit``, ``unit_source``, ``unit_ambiguous`` and ``quality_phred33``.

    What the run states holds, also lane by lane; a fragment with no lane in a run
    with a rule by lane is read by its values. Null qualities keep null in the
    new columns. Repeated rows stay repeated. A column of the input with the name
    of a new column is kept as ``input_<name>``.
    """
    joined = keyed_join(set_aside(fragments, NEW), stated_units(runs, key), [key], "left")
    claim = F.when(F.col("lane_cut").isNull(), F.col("unit_below")).when(F.col(lane).isNotNull(), F.when(F.col(lane) < F.col("lane_cut"), F.col("unit_below")).otherwise(F.col("unit_from")))
    q = F.col(quality)
    valued = joined.withColumn("_values", F.when(q.rlike(r"^\s*[-+.0-9]"), _values(q)).otherwise(F.array().cast("array<double>")))
    readings = quality_readings(F.col("_values"), q, F.col(bases))
    resolved = resolve_units(valued, readings, F.when(q.isNotNull(), claim), MAX_LOG_RESIDUAL)
    return convert(resolved, readings, "quality_phred33").drop("_values", "lane_cut", "unit_below", "unit_from")
