"""Read identifiers, QSEQ and FASTQ text of fragments, and small parsers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helica.functions.quality import sanger_to_illumina
from helica.operators.joins import keyed_join
from helica.operators.rejects import computed_once

#: The identifier of sequencer software from 1.8 on: seven fields, blanks, four fields; those with a rule below have to follow it.
RUN_ID_PARTS = (("instrument", "string"), ("run_number", "int"), ("flowcell_id", "string"), ("lane", "int"), ("tile", "int"), ("xpos", "int"), ("ypos", "int"), ("read", "int"), ("filter_passed", "boolean"), ("control_number", "int"), ("index_sequence", "string"))
SIGNED = ("xpos", "ypos")


def run_id_fields(name: Column) -> Column:
    """The eleven fields of an identifier as texts, null where a name has another number of them; the last may hold anything."""
    sides = F.split(name, r"\s+", 2)
    fields = F.concat(F.split(F.get(sides, F.lit(0)), ":"), F.split(F.get(sides, F.lit(1)), ":", 4))
    return F.when(F.size(fields) == len(RUN_ID_PARTS), fields)


def parse_run_id(name: Column, use: Column | None = None, fields: Column | None = None) -> dict[str, Column]:
    """The eleven parts of an identifier; null where it has another form or ``use`` is false.

    ``N`` (not filtered) means passed. Flowcell and index may be empty texts. A name
    of another form gives its read number alone, from ``/<digit>`` at the end.
    ``fields`` are the name's ``run_id_fields``, if they are at hand.
    """
    fields = run_id_fields(name) if fields is None else fields
    at = {part: F.get(fields, F.lit(i)) for i, (part, _) in enumerate(RUN_ID_PARTS)}

    def number(part: str) -> Column:
        digits = at[part]
        if part in SIGNED:
            digits = F.when(digits.startswith("-"), F.substring(digits, F.lit(2), F.length(digits))).otherwise(digits)
        return (F.length(digits) > 0) & (F.translate(digits, "0123456789", "") == "") & at[part].try_cast("int").isNotNull()

    rules = [F.size(fields) == len(RUN_ID_PARTS), at["instrument"] != "", at["read"].isin("1", "2", "3"), at["filter_passed"].isin("Y", "N")]
    known = reduce(lambda a, b: a & b, [*rules, *(number(p) for p, kind in RUN_ID_PARTS if kind == "int")])
    known = F.coalesce(known if use is None else known & use, F.lit(False))
    parts = {p: F.when(known, at[p] == "N" if kind == "boolean" else at[p].try_cast(kind)) for p, kind in RUN_ID_PARTS}
    last = F.right(name, F.lit(2))
    plain = F.when((F.length(last) == 2) & (F.translate(last, "0123456789", "") == "/") & last.startswith("/"), F.right(name, F.lit(1)).try_cast("int"))
    parts["read"] = F.when(known, at["read"].try_cast("int")).otherwise(plain)
    return parts


def with_run_id(df: DataFrame, name: str = "key", sticky: bool = False, file: str | None = None, order: str | None = None) -> DataFrame:
    """Add the parts of the identifier.

    ``sticky`` stops at the first name of another form in a file, by ``order``:
    later names give only their read number. The first such place is one
    aggregate for each file, so no file is put in order.
    """
    use = None
    df = computed_once(df, _id=run_id_fields(F.col(name)))
    if sticky:
        if not file or not order:
            raise ValueError("sticky needs the columns of file and order")
        other = parse_run_id(F.col(name), None, F.col("_id"))["filter_passed"].isNull() & F.col(name).isNotNull()
        first = df.where(other).groupBy(file).agg(F.min(order).alias("_first_other"))
        df = keyed_join(df, first, [file], "left")
        use = F.col("_first_other").isNull() | (F.col(order) < F.col("_first_other"))
    return df.withColumns(parse_run_id(F.col(name), use, F.col("_id"))).drop("_first_other", "_id")


def _text(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def fastq_id(columns: dict[str, Column]) -> Column:
    """The identifier of a fragment: null parts are empty, a null filter is passed, a null control number 0."""
    c = columns
    passed = F.when(F.coalesce(c["filter_passed"], F.lit(True)), "N").otherwise("Y")
    head = F.concat_ws(":", *(_text(c[k]) for k in ("instrument", "run_number", "flowcell_id", "lane", "tile", "xpos", "ypos")))
    tail = F.concat_ws(":", _text(c["read"]), passed, _text(c["control_number"], "0"), _text(c["index_sequence"]))
    return F.concat(head, F.lit(" "), tail)


def qseq_line(columns: dict[str, Column], illumina: bool = True) -> Column:
    """A QSEQ line: no index is ``0``, ``N`` is ``.``, qualities are Phred+64 unless told otherwise."""
    c = columns
    index = F.when(F.coalesce(c["index_sequence"], F.lit("")) == "", "0").otherwise(F.translate(c["index_sequence"], "N", "."))
    quality = _text(sanger_to_illumina(c["quality"]) if illumina else c["quality"])
    passed = F.when(F.coalesce(c["filter_passed"], F.lit(True)), "1").otherwise("0")
    return F.concat_ws("\t", *(_text(c[k]) for k in ("instrument", "run_number", "lane", "tile", "xpos", "ypos")), index, _text(c["read"]), _text(F.translate(c["sequence"], "N", ".")), quality, passed)


def qseq_key(columns: dict[str, Column]) -> Column:
    """The first six fields and the read number, joined by colons."""
    return F.concat_ws(":", *(_text(columns[k]) for k in ("instrument", "run_number", "lane", "tile", "xpos", "ypos", "read")))


def passes_qc(filter_passed: Column) -> Column:
    """True unless the filter says failed."""
    return F.coalesce(filter_passed, F.lit(True))


def parse_boolean(text: str | None, default: bool) -> bool:
    """yes, true, t, y, 1 and no, false, f, n, 0, without regard to case and blanks; None gives the default."""
    if text is None:
        return default
    word = text.strip().lower()
    if word in ("yes", "true", "t", "y", "1"):
        return True
    if word in ("no", "false", "f", "n", "0"):
        return False
    raise ValueError(f"not a boolean: {text!r}")


