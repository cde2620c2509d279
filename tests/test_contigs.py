"""Queries that write files of reads, over alignments with contigs that the fixed header does not have."""

import duckdb
import pytest

import __spark_entry__
from helica.plans.genomic_queries import HEADER, header_of

ALIGNMENTS = "/root/testdata/sf0.001/alignments.parquet"
#: Two contigs of the table take the names of the ones behind the header's.
OTHER = "CASE {0} WHEN 'chr1' THEN 'chr24' WHEN 'chr2' THEN 'chr25' ELSE {0} END AS {0}"


def folder_of(path, *replaced):
    changes = ", ".join([OTHER.format("contig"), OTHER.format("mate_contig"), *replaced])
    duckdb.sql(f"COPY (SELECT * REPLACE ({changes}) FROM '{ALIGNMENTS}') TO '{path}/alignments.parquet' (FORMAT parquet)")
    return str(path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return folder_of(tmp_path_factory.mktemp("contigs"))


def expected(name, folder):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW alignments AS FROM '{folder}/alignments.parquet'")
    return sorted(db.sql(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)


def found(spark, name, folder):
    return sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()), key=str)


def test_header_has_the_contigs_of_the_reads(spark, folder):
    assert header_of(spark, folder).names == [*HEADER.names, "chr24", "chr25"]
    assert header_of(spark, ALIGNMENTS.rpartition("/")[0]) == HEADER


@pytest.mark.parametrize("name", ["bai_intervals", "bam_key_ignored", "bam_unplaced", "parts_of_a_write", "starts_guessed", "bai_ranges", "bam_merge", "cram_intervals", "index_asked", "read_unmapped_key", "bam_intervals", "bam_roundtrip", "cram_roundtrip", "index_built", "reads_of_mixed_formats"])
def test_other_contigs(spark, folder, name):
    assert found(spark, name, folder) == expected(name, folder)


def test_printed_header_has_other_contigs(spark, folder):
    lines = [line for _, line in sorted(found(spark, "tool_header", folder))]
    assert lines[1:] == [f"@SQ\tSN:{n}\tLN:250000000" for n in [*HEADER.names, "chr24", "chr25"]]


NAMES = ("read_name || chr(8242) || chr(233) AS read_name", "opt_tags || chr(9) || 'CO:Z:' || chr(8242) AS opt_tags")


def test_bam_names_outside_latin(spark, tmp_path):
    folder = folder_of(tmp_path, *NAMES)
    assert found(spark, "bam_roundtrip", folder) == expected("bam_roundtrip", folder)


def test_bam_names_of_latin_bytes_and_long_ones(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    from helica.sources.bam_codec import _strings, encode_batch

    assert _strings(np.frombuffer(b"a\xe9b", np.uint8), np.array([2, 1])).to_pylist() == ["aé", "b"]
    row = {"read_name": "é" * 128, "contig": None, "mate_contig": None, "cigar": "*", "bases": "*", "quals": "*", "tags": ""}
    with pytest.raises(ValueError, match="254 bytes"):
        encode_batch(pa.RecordBatch.from_pylist([row | dict.fromkeys(("start", "mapq", "flags", "mate_start", "insert_size"), 0)]), {})


def test_cram_names_outside_latin(spark, tmp_path):
    folder = folder_of(tmp_path, *NAMES)
    assert found(spark, "cram_roundtrip", folder) == expected("cram_roundtrip", folder)


LONG = "CASE WHEN read_id % 97 = 0 THEN repeat('1M1D', 35000) ELSE cigar END AS cigar"


@pytest.mark.parametrize("name", ["bai_ranges", "bam_intervals", "bam_roundtrip"])
def test_cigars_of_more_steps_than_the_fixed_fields_count(spark, tmp_path, name):
    folder = str(tmp_path)
    duckdb.sql(f"COPY (SELECT * REPLACE ({LONG}) FROM '{ALIGNMENTS}') TO '{folder}/alignments.parquet' (FORMAT parquet)")
    assert found(spark, name, folder) == expected(name, folder)


def test_keys_of_long_cigars(spark, tmp_path):
    folder = str(tmp_path)
    duckdb.sql(f"COPY (SELECT * REPLACE ({LONG}) FROM '{ALIGNMENTS}') TO '{folder}/alignments.parquet' (FORMAT parquet)")
    assert found(spark, "read_unmapped_key", folder) == found(spark, "read_unmapped_key_of_rows", folder)


def test_longest_cigar_of_the_fixed_fields_and_the_next():
    import numpy as np
    import pyarrow as pa

    from helica.sources.bam_codec import FIXED, decode_records, encode_batch
    from helica.sources.sam import SamHeader

    row = {"read_name": "r", "contig": "chr1", "mate_contig": None, "bases": "ACG", "quals": "III", "tags": "CG:Z:x\tNM:i:1\tXB:B:c,1,2\tXA:A:y"}
    rows = [row | dict.fromkeys(("mapq", "flags", "mate_start", "insert_size"), 0) | {"start": 5, "cigar": c} for c in ("1M" * 65535, "1M" * 65536, "3S7N")]
    data, starts = encode_batch(pa.RecordBatch.from_pylist(rows), {"chr1": 0})
    assert [np.frombuffer(data, FIXED, 1, s)["n_cigar"][0] for s in starts] == [65535, 2, 2]
    read = decode_records(data, starts, SamHeader.of_contigs([("chr1", 1000)])).to_pylist()
    assert [(r["cigar"], r["end"], r["tags"]) for r in read] == [(r["cigar"], e, r["tags"]) for r, e in zip(rows, (65539, 65540, 11))]
