"""Loading rows of which some do not parse, and keeping the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``reason`` holds for a row whose ``fails`` is true; null counts as false."""

    reason: str
    fails: Column


def with_errors(df: DataFrame, rules: list[Rule], name: str = "errors") -> DataFrame:
    """Add the reasons of all rules that fail, in the order of the rules."""
    found = F.array(*(F.when(F.coalesce(r.fails, F.lit(False)), F.lit(r.reason)) for r in rules))
    return computed_once(df, **{name: F.array_compact(found)})


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later steps use them.

    They come from a generator of one row, which the optimizer does not merge
    with filters and projections after it.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def split_rows(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The rows with no error, and the others with ``fail_reason`` (the first) and ``errors``."""
    checked = with_errors(df, rules, "errors")
    good = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0).withColumn("fail_reason", F.get("errors", F.lit(0)))
    return good, bad


def split_quoted(line: Column, delimiter: str = "\t") -> tuple[Column, Column]:
    """Fields of a delimited line with optional ``"`` quoting, and whether the quoting is right.

    Without a ``"`` this is a plain split. Otherwise the line is cut at each
    ``"``: parts with an even number lie outside quotes. Outside parts between
    two quoted ones have to be empty (a doubled quote) or begin and end with the
    delimiter. Nothing recurses, so a line may have any length. In a line with
    broken quoting the fields are without meaning.
    """
    parts = F.split(line, '"')
    n = F.size(parts)
    ok = (n % 2 == 1) & F.forall(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: (x["i"] % 2 == 1)
        | (
            (x["p"] == "")
            | (
                ((x["i"] == 0) | x["p"].startswith(delimiter))
                & ((x["i"] == n - 1) | x["p"].endswith(delimiter))
            )
        ),
    )
    # A delimiter inside quotes is hidden as SUB + "1", and SUB itself as SUB + "0".
    hidden = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("\x1a"), F.lit("\x1a0")), F.lit(delimiter), F.lit("\x1a1"))).otherwise(F.replace(p, F.lit("\x1a"), F.lit("\x1a0"))))
    raw = F.split(F.array_join(hidden, '"'), delimiter)

    unquoted = F.transform(raw, lambda f: _unquote(f, delimiter))
    has_quote = F.contains(line, F.lit('"'))
    return F.when(has_quote, unquoted).otherwise(F.split(line, delimiter)), F.when(has_quote, ok).otherwise(F.lit(True))


def _unquote(field: Column, delimiter: str) -> Column:
    enclosed = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    inner = F.when(field.startswith('"'), enclosed).otherwise(field)
    return F.replace(F.replace(inner, F.lit("\x1a1"), F.lit(delimiter)), F.lit("\x1a0"), F.lit("\x1a"))
