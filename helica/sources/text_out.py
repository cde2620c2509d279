"""Fields of lines, and lines in front of every file of a text write."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: What to do with malformed rows; the names of stringencies are accepted too. ``LENIENT`` leaves them out with a warning.
MODES = {"FAILFAST": "FAILFAST", "STRICT": "FAILFAST", "DROPMALFORMED": "DROPMALFORMED", "LENIENT": "LENIENT", "SILENT": "DROPMALFORMED"}


def checked_mode(mode: str) -> str:
    if mode.upper() not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return MODES[mode.upper()]


def without_malformed(rows: DataFrame, bad: Column, mode: str, what: str, line: str = "_line") -> DataFrame:
    """``rows`` without those that are ``bad``: an error for the first with ``FAILFAST``, else they are left out.

    With ``LENIENT`` they are counted where the rows are read, and the count of the
    first action on the result comes as a warning once that has finished.
    """
    if mode == "FAILFAST":
        return rows.where(F.when(bad, F.raise_error(F.concat(F.lit(f"malformed {what} line: "), F.col(line)))).otherwise(F.lit(True)))
    if mode == "LENIENT" and not rows.isStreaming:
        seen = Observation()
        rows = rows.observe(seen, F.count_if(bad).alias("n"), F.first(F.when(bad, F.substring(line, 1, 200)), ignorenulls=True).alias("example"))
        threading.Thread(target=_warn, args=(seen, what), daemon=True).start()
    return rows.where(~bad)


def _warn(seen: Observation, what: str) -> None:
    """Wait for the first action, then tell how many lines it left out."""
    try:
        found = seen.get
    except Exception:  # the session ended without one
        return
    if found.get("n"):
        log.warning("%d malformed %s lines were left out, such as: %s", found["n"], what, found["example"])


def split_once(lines: DataFrame, column: str, by: str = "\t") -> DataFrame:
    """``_line`` and its fields ``_f``.

    The pair comes from a generator of one row, which the optimizer does not
    merge with what follows: otherwise every use of a field would make and split
    the line again.
    """
    line = F.col(column)
    return lines.select(F.inline(F.array(F.struct(line.alias("_line"), F.split(line, by).alias("_f")))))


def with_top_lines(lines: DataFrame, top: list[str]) -> DataFrame:
    """``lines`` (one column, ``value``) with ``top`` at the start of each partition."""
    import pyarrow as pa

    schema = pa.schema([("value", pa.string())])

    def add(batches):
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string())], schema=schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], schema=schema)

    return lines.mapInArrow(add, "value string")
