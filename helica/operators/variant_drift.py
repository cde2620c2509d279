"""Variant files whose dictionaries and sample lists drift, as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helica.operators.drift import field_changes, member_changes, squeezed, version_order
from helica.operators.joins import is_bounded, keyed_join
from helica.operators.rejects import computed_once
from helica.session import cut_lineage


def value_sketches(variants: DataFrame, fields: DataFrame) -> DataFrame:
    """A sketch of each field's values: share of numbers, mean log size, mean length, mean number of parts.

    FORMAT values come from the genotypes, INFO values from ``info_raw``. All four
    are means, so Spark combines them before the shuffle.
    """
    info = variants.select("file_id", F.explode(F.split("info_raw", ";")).alias("e")).select(
        "file_id", F.lit("INFO").alias("field_class"), F.split_part("e", F.lit("="), F.lit(1)).alias("field_id"), F.expr("substring(e, locate('=', e) + 1)").alias("v")
    )
    gt = variants.select("file_id", "format_pos", F.explode(F.split("genotypes_raw", "\t")).alias("g"))
    gt = gt.select("file_id", F.explode(F.arrays_zip("format_pos", F.split("g", ":").alias("v"))).alias("z")).select("file_id", F.col("z.format_pos").alias("dict_pos"), F.col("z.v").alias("v"))

    def means(df: DataFrame, *keys: str) -> DataFrame:
        head = F.split_part("v", F.lit(","), F.lit(1)).try_cast("double")
        return df.where(F.col("v").isNotNull() & (F.col("v") != ".")).groupBy(*keys).agg(
            F.array(F.avg(head.isNotNull().cast("double")), F.avg(F.log1p(F.abs(head))), F.avg(F.length("v").cast("double")), F.avg(F.size(F.split("v", ",")).cast("double"))).alias("sketch")
        )

    by_pos = means(gt, "file_id", "dict_pos").join(fields.where(F.col("field_class") == "FORMAT").select("file_id", "dict_pos", "field_id"), ["file_id", "dict_pos"])
    return means(info, "file_id", "field_id").withColumn("field_class", F.lit("INFO")).unionByName(by_pos.drop("dict_pos").withColumn("field_class", F.lit("FORMAT")))


def clean_fields(fields: DataFrame) -> DataFrame:
    """One row for each field of a file; repeated rows fold into one. Rows without file, class or id are no fields."""
    return (
        fields.where(F.col("file_id").isNotNull() & F.col("field_class").isNotNull() & F.col("field_id").isNotNull())
        .groupBy("file_id", "field_class", "field_id")
        .agg(F.min("dict_pos").alias("dict_pos"), F.min(F.lower(F.trim("value_type"))).alias("value_type"), F.min(F.trim("value_count")).alias("value_count"), F.min(squeezed(F.col("field_text"))).alias("field_text"))
    )


def dictionary_changes(files: DataFrame, fields: DataFrame, variants: DataFrame, same_text: bool = True) -> DataFrame:
    """Every change of a file against the one before it in its cohort, by ``file_seq``.

    Columns: version (file_id), kind, name, change, old_name, likeness. Files with a null
    cohort or sequence number have no file before them. Of two files with the
    same number the lower file_id comes first. All rows are read for the values of
    the fields that may be renamed; those of files without one go no further.
    """
    # Both are small beside the variants and used on every side of the comparison: written once.
    order = cut_lineage(version_order(files, "cohort_id", "file_seq", "file_id"))
    clean = cut_lineage(clean_fields(fields))
    profiles = clean.select(F.col("file_id").alias("version"), F.col("field_class").alias("kind"), F.col("field_id").alias("name"), F.col("field_text").alias("text"), F.col("value_type").alias("type"), F.col("value_count").alias("count"))

    def sketch_of(wanted: DataFrame) -> DataFrame:
        of = wanted.select(F.col("version").alias("file_id")).distinct()
        known = clean.join(of, "file_id", "left_semi")
        rows = variants.join(F.broadcast(of) if is_bounded(of) else of, "file_id", "left_semi")
        return value_sketches(rows, known).select(F.col("file_id").alias("version"), F.col("field_class").alias("kind"), F.col("field_id").alias("name"), "sketch")

    samples = sample_lists(files).select(F.col("file_id").alias("version"), F.col("samples").alias("members"))
    return field_changes(profiles, order, same_text, sketch_of).unionByName(member_changes(samples, order, "SAMPLE"))


def sample_lists(files: DataFrame) -> DataFrame:
    """file_id and its trimmed ``samples``, one row a file; null lists are empty."""
    return files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.first("sample_names_in_order", ignorenulls=True).alias("s")).select("file_id", F.transform(F.coalesce("s", F.array().cast("array<string>")), lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")).alias("samples"))


GROUP = ["cohort_id", "field_class"]


def _last_before(asked: DataFrame, events: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: the latest event (column ``event``, at ``at``) of the same keys before each row's ``at``; null if there is none. Null keys equal each other."""
    both = asked.withColumn("event", F.lit(None).cast(events.schema["event"].dataType)).withColumn("_asks", F.lit(True)).unionByName(events.select(*keys, "at", "event").withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # At the same place a question comes before an event, so it only sees those before it.
    past = Window.partitionBy(*keys).orderBy("at", F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last("event", ignorenulls=True).over(past)).where("_asks").drop("event", "_asks")


def field_roots(cohort: DataFrame, clean: DataFrame, changes: DataFrame) -> DataFrame:
    """Where the life of each field began: cohort_id, field_class, name, at, root; ``at`` and ``root.at`` are (file_seq, file_id).

    A field lives from the file that first has it to the one where its name is gone. A
    rename carries it on under the new name. A field that is added with the text of
    one that was removed earlier, and that no other continued since, is that field
    again. So a name that is used again for another text is another field. Only
    beginnings, which are far fewer than fields of files, take part; chains are
    followed by doubling, one join a step.
    """
    at = F.struct("file_seq", "file_id").alias("at")
    placed = cohort.where(F.col("cohort_id").isNotNull() & F.col("file_seq").isNotNull())
    where = placed.select("file_id", "cohort_id", at)
    moved = changes.where(F.col("kind") != "SAMPLE").select(F.col("version").alias("file_id"), F.col("kind").alias("field_class"), F.col("name").alias("field_id"), "change", "old_name").where(F.col("change").isin("added", "renamed", "removed"))
    first = placed.groupBy("cohort_id").agg(F.min(at).alias("at")).select("cohort_id", "at", F.col("at.file_id").alias("file_id"))
    begun = clean.join(first, "file_id").select(*GROUP, F.col("field_id").alias("name"), "at", F.lit(None).cast("string").alias("old_name"), "field_text")
    later = moved.join(where, "file_id").join(clean.select("file_id", "field_class", "field_id", "field_text"), ["file_id", "field_class", "field_id"], "left")
    begun = cut_lineage(begun.unionByName(later.where(F.col("change") != "removed").select(*GROUP, F.col("field_id").alias("name"), "at", "old_name", "field_text")))
    node = F.struct("name", "at")
    births = begun.select(*GROUP, "name", "at", node.alias("event"))
    carried = _last_before(begun.where(F.col("old_name").isNotNull()).select(*GROUP, F.col("old_name").alias("name"), F.col("name").alias("new_name"), "at"), births, [*GROUP, "name"], "up")
    carried = carried.select(*GROUP, F.col("new_name").alias("name"), "at", "up")
    # A removed field, with its text in the file before, and where it began.
    prior = version_order(placed, "cohort_id", "file_seq", "file_id").where(F.col("previous").isNotNull()).select(F.col("version").alias("file_id"), F.col("previous"))
    texts = clean.select(F.col("file_id").alias("previous"), "field_class", "field_id", F.col("field_text").alias("text")).where(F.coalesce("field_text", F.lit("")) != "")
    ended = moved.where(F.col("change") == "removed").join(where, "file_id").join(prior, "file_id").join(texts, ["previous", "field_class", "field_id"]).select(*GROUP, F.col("field_id").alias("name"), "at", "text")
    ended = _last_before(ended, births, [*GROUP, "name"], "up").where(F.col("up").isNotNull()).groupBy(*GROUP, "text", "at").agg(F.min(F.struct("name", "up")).alias("e")).select(*GROUP, "text", "at", F.col("e.up").alias("event"))
    fresh = begun.where(F.col("old_name").isNull() & (F.coalesce("field_text", F.lit("")) != "")).select(*GROUP, "name", "at", F.col("field_text").alias("text"))
    again = _last_before(fresh, ended, [*GROUP, "text"], "up").where(F.col("up").isNotNull())
    again = again.withColumn("n", F.row_number().over(Window.partitionBy(*GROUP, "up").orderBy("at", "name"))).where(F.col("n") == 1).select(*GROUP, "name", "at", "up")
    links = begun.select(*GROUP, "name", "at").join(carried.unionByName(again), [*GROUP, "name", "at"], "left").withColumn("root", F.coalesce("up", node)).drop("up")
    while True:
        links = cut_lineage(links)
        above = links.select(*GROUP, node.alias("root"), F.col("root").alias("higher"))
        stepped = links.join(above, [*GROUP, "root"], "left").withColumn("higher", F.coalesce("higher", "root"))
        if not stepped.where(F.col("higher") != F.col("root")).limit(1).count():
            return links
        links = stepped.select(*GROUP, "name", "at", F.col("higher").alias("root"))


def canonical_fields(files: DataFrame, fields: DataFrame, changes: DataFrame) -> DataFrame:
    """file_id, field_class, field_id, dict_pos, value_type, cohort_id, ``canonical``: one name for a field through its whole life in a cohort.

    The name is the one the cohort used first for that field. Where a later field of
    the cohort began under the same name, it has ``@2`` behind it, the next ``@3``
    and so on. Fields of files without a cohort or number keep their names.
    """
    cohort = files.select("file_id", "cohort_id", "file_seq").where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("cohort_id", "file_seq")).alias("k")).select("file_id", "k.*")
    clean = cut_lineage(clean_fields(fields))
    roots = cut_lineage(field_roots(cohort, clean, changes))
    rank = Window.partitionBy(*GROUP, "root.name").orderBy("root.at")
    named = roots.select(*GROUP, "root").distinct().withColumn("n", F.row_number().over(rank))
    named = named.select(*GROUP, "root", F.when(F.col("n") == 1, F.col("root.name")).otherwise(F.concat("root.name", F.lit("@"), "n")).alias("canonical"))
    births = roots.join(named, [*GROUP, "root"]).select(*GROUP, F.col("name").alias("field_id"), "at", F.col("canonical").alias("event"))
    placed = clean.join(cohort, "file_id", "left").withColumn("at", F.struct("file_seq", (F.col("file_id") + 1).alias("file_id")))
    # A field's file comes right after a beginning in the same file, so the one of its own file counts.
    found = _last_before(placed, births, [*GROUP, "field_id"], "canonical")
    return found.withColumn("canonical", F.coalesce("canonical", "field_id")).drop("at", "file_seq")


#: Declared types from the narrowest to the widest.
TYPES = ("Flag", "Integer", "Float", "String")


def _width_of(value_type: Column) -> Column:
    return F.when(value_type == "flag", 0).when(value_type == "integer", 1).when(value_type == "float", 2).otherwise(3)


def _widths(named: DataFrame) -> DataFrame:
    """The widest type of each canonical field of a cohort, as its place in ``TYPES``."""
    return named.groupBy("cohort_id", "field_class", "canonical").agg(F.max(_width_of(F.col("value_type"))).alias("width"), F.count_distinct("field_id").alias("n_names"), F.count(F.lit(1)).alias("n_files"))


def unify_variants(files: DataFrame, fields: DataFrame, variants: DataFrame, changes: DataFrame) -> DataFrame:
    """All variants in one layout: a row for each variant and sample.

    ``format_values`` and ``info_values`` are arrays of (field, value, number) under
    the canonical names of the cohort, whatever the file's positions and names;
    ``.`` and missing values are null. ``number`` is the value in the unified type
    where that is Integer or Float, null where it is no single number. A repeated
    variant_id keeps its earliest loaded row, rows without an id are left out;
    variants of files without samples or without a file keep one row with a null
    sample.
    """
    named = cut_lineage(canonical_fields(files, fields, changes))
    widths = _widths(named.where(F.col("cohort_id").isNotNull())).select("cohort_id", "field_class", "canonical", "width")
    named = cut_lineage(keyed_join(named, widths, ["cohort_id", "field_class", "canonical"], "left").withColumn("numeric", F.coalesce("width", _width_of(F.col("value_type"))).isin(1, 2)))
    formats = named.where(F.col("field_class") == "FORMAT").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("dict_pos", "canonical", "numeric"))).alias("format_names"))
    infos = named.where((F.col("field_class") == "INFO") & ((F.col("field_id") != F.col("canonical")) | F.col("numeric"))).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("field_id", "canonical", "numeric"))).alias("info_names"))
    lists = sample_lists(files).join(files.select("file_id", "cohort_id").dropDuplicates(["file_id"]), "file_id")
    layout = lists.join(formats, "file_id", "left").join(infos, "file_id", "left")
    payload = ["file_id", "contig", "pos", "var_name", "ref_allele", "alt_alleles", "qual", "filters", "info_raw", "format_pos", "genotypes_raw", "loaded_at"]
    unique = variants.where(F.col("variant_id").isNotNull()).groupBy("variant_id").agg(F.min_by(F.struct(*payload), F.struct(F.col("loaded_at").isNull(), "loaded_at", F.xxhash64(*payload))).alias("r")).select("variant_id", "r.*")
    cells_held = sum((F.greatest(F.size(c), F.lit(0)) for c in ("format_names", "info_names")), F.size("samples") + 1)
    rows = keyed_join(unique, layout, ["file_id"], "left", weight=cells_held)
    # What all samples of a variant share is made before they are told apart.
    key = lambda e: F.split_part(e, F.lit("="), F.lit(1))
    dot = lambda v: F.when(v != ".", v)
    number = lambda v, numeric: F.when(numeric, v.try_cast("double"))
    places = F.transform(F.col("format_pos"), lambda p: F.get(F.filter(F.col("format_names"), lambda n: n["dict_pos"] == p), F.lit(0)))
    entry = lambda e: F.struct(key(e).alias("id"), dot(F.when(F.contains(e, F.lit("=")), F.substring(e, F.instr(e, "=") + 1, F.length(e)))).alias("value"), F.get(F.filter(F.col("info_names"), lambda n: n["field_id"] == key(e)), F.lit(0)).alias("known"))
    info = F.transform(
        F.transform(F.split("info_raw", ";"), entry),
        lambda e: F.struct(F.coalesce(e["known"]["canonical"], e["id"]).alias("field"), e["value"].alias("value"), number(e["value"], F.coalesce(e["known"]["numeric"], F.lit(False))).alias("number")),
    )
    cells = F.arrays_zip(F.split("genotypes_raw", "\t").alias("genotype"), F.col("samples").alias("sample"))
    shared = computed_once(rows, places=places, info_values=info, cells=cells).withColumn("all_known", ~F.exists("places", lambda p: p.isNull()))
    wide = shared.select("*", F.explode_outer("cells").alias("cell"))
    pairs = F.zip_with("places", F.split("cell.genotype", ":"), lambda p, v: F.struct(p["canonical"].alias("field"), dot(v).alias("value"), number(dot(v), p["numeric"]).alias("number")))
    as_long = F.size(F.split("cell.genotype", ":")) <= F.size("places")
    values = F.when(F.col("all_known") & as_long, pairs).otherwise(F.filter(pairs, lambda v: v["field"].isNotNull()))
    return wide.select("variant_id", "cohort_id", "file_id", "contig", "pos", "var_name", "ref_allele", F.split("alt_alleles", ",").alias("alt_alleles"), "qual", "filters", F.col("cell.sample").alias("sample_name"), values.alias("format_values"), "info_values")


def unified_types(files: DataFrame, fields: DataFrame, changes: DataFrame) -> DataFrame:
    """The widest type each canonical field has in its cohort: flag < integer < float < string."""
    back = F.element_at(F.array(*map(F.lit, TYPES)), F.col("width") + 1)
    return _widths(canonical_fields(files, fields, changes)).select("cohort_id", "field_class", "canonical", back.alias("unified_type"), "n_names", "n_files")
