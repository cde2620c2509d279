"""Lines of QSEQ files as typed rows, the broken ones with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.operators.clashes import set_aside
from helica.operators.rejects import Rule, computed_once, split_quoted, split_rows

FIELDS = ("instrument", "run", "lane", "tile", "xpos", "ypos", "index", "read", "sequence", "quality", "filter")
NEW = {*FIELDS, "filter_passed", "errors", "fail_reason", "_text", "_fields", "_quoted_well"}
NUMBERS = ("run", "lane", "tile", "xpos", "ypos", "read")


def parse_qseq_lines(df: DataFrame, line: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """Valid lines as typed columns, and the other rows with ``fail_reason`` and ``errors``.

    Every field is first loaded as nullable text; the checks ``quoting``,
    ``columns``, ``number``, ``bases``, ``quality``, ``length`` and ``filter_flag``
    then run as expressions over all rows, and the first that fails is the reason.
    One CR at the end belongs to the line end. A null line counts as an empty one
    and fails ``columns``. The rows keep their other columns; a column of the input
    with the name of a new column is kept under ``input_<name>``. Lines may have
    any length. Valid rows have ``.`` as ``N`` in sequence and index, index ``0``
    as null and the quality as given (Phred+64).
    """
    if line in NEW:
        raise ValueError(f"{line} is the name of a new column")
    kept = set_aside(df, NEW)
    text = F.coalesce(F.col(line), F.lit(""))
    text = F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    kept = computed_once(kept, _text=text)
    fields, quoted_well = split_quoted(F.col("_text"))
    loaded = computed_once(kept, _fields=fields, _quoted_well=quoted_well)

    def field(name: str) -> Column:
        return F.get("_fields", F.lit(FIELDS.index(name)))

    def not_int(c: Column) -> Column:
        return ~c.rlike(r"^-?[0-9]+\z") | c.try_cast("int").isNull()

    rules = [
        Rule("quoting", ~F.col("_quoted_well")),
        Rule("columns", F.size("_fields") != len(FIELDS)),
        Rule("number", F.exists(F.array(*map(field, NUMBERS)), not_int)),
        Rule("bases", ~field("sequence").rlike(r"^[ACGTN.]+\z") | ~field("index").rlike(r"^([ACGTN.]+|0)\z")),
        Rule("quality", ~field("quality").rlike(r"^[@-~]*\z")),
        Rule("length", F.length(field("quality")) != F.length(field("sequence"))),
        Rule("filter_flag", ~field("filter").isin("0", "1")),
    ]
    good, bad = split_rows(loaded, rules)
    typed = [field(c).try_cast("int").alias(c) if c in NUMBERS else field(c).alias(c) for c in FIELDS[:6]]
    valid = good.select(
        *(F.col(c) for c in kept.columns if c not in (line, "_text")),
        *typed,
        F.when(field("index") != "0", F.translate(field("index"), ".", "N")).alias("index"),
        field("read").try_cast("int").alias("read"),
        F.translate(field("sequence"), ".", "N").alias("sequence"),
        field("quality").alias("quality"),
        (field("filter") == "1").alias("filter_passed"),
    )
    return valid, bad.drop("_text", "_fields", "_quoted_well")
