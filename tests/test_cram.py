import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helica.functions.intervals import parse_intervals
from helica.sources import cram_codec as C
from helica.sources.cram import containers, read_cram_header, splits
from helica.sources.merge import merge_reads
from helica.sources.reads import load_reads, read_cram, read_sam_header, write_reads
from helica.sources.sam import READ_COLUMNS, SamHeader
from tests.make_reads import HEADER, read_rows, reads


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*READ_COLUMNS).collect())


@given(st.integers(-(2**31), 2**31 - 1))
def test_numbers_come_back(n):
    assert C.Cursor(C.put_number(n)).number() == n


@given(st.integers(0, 2**56 - 1))
def test_long_numbers_come_back(n):
    assert C.Cursor(C.put_long(n)).long() == n


# --- the entropy coding, written here in the simplest way ----------------------


def shares(data, total=4096):
    """Frequencies that sum up to ``total``."""
    counts = {b: data.count(b) for b in sorted(set(data))}
    share = {b: max(1, n * total // len(data)) for b, n in counts.items()}
    share[max(share, key=share.get)] += total - sum(share.values())
    return share


def table(share, one):
    out, symbols, k = b"", sorted(share), 0
    while k < len(symbols):
        out += bytes([symbols[k]])
        run = 0
        if k and symbols[k] == symbols[k - 1] + 1:
            while k + run + 1 < len(symbols) and symbols[k + run + 1] == symbols[k] + run + 1:
                run += 1
            out += bytes([run])
        for j in range(run + 1):
            out += one(symbols[k + j])
        k += run + 1
    return out + b"\0"


def frequency(n):
    return bytes([n]) if n < 128 else bytes([128 | n >> 8, n & 255])


def rans(data, order):
    def first_slots(share):
        at, found = 0, {}
        for b in sorted(share):
            found[b] = at
            at += share[b]
        return found

    quarter = len(data) // 4
    if order == 0:
        tables = {None: shares(data)}
        steps = [(i % 4, None, b) for i, b in enumerate(data)]
        head = table(tables[None], lambda b: frequency(tables[None][b]))
    else:
        places = [(k, k * quarter + i) for i in range(quarter) for k in range(4)] + [(3, i) for i in range(4 * quarter, len(data))]
        steps = [(k, 0 if i % quarter == 0 and i // quarter < 4 and i == k * quarter else data[i - 1], data[i]) for k, i in places]
        tables = {c: shares(bytes(b for _, x, b in steps if x == c)) for c in {x for _, x, _ in steps}}
        head = table(tables, lambda c: table(tables[c], lambda b: frequency(tables[c][b])))
    states, tail = [1 << 23] * 4, bytearray()
    firsts = {c: first_slots(s) for c, s in tables.items()}
    for k, c, b in reversed(steps):
        n, x = tables[c][b], states[k]
        while x >= (n << 19):
            tail.append(x & 255)
            x >>= 8
        states[k] = (x // n << 12) + x % n + firsts[c][b]
    body = head + struct.pack("<4I", *states) + bytes(reversed(tail))
    return struct.pack("<BII", order, len(body), len(data)) + body


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(b"ACGTN!IJK\x01"), min_size=8, max_size=400).map(bytes), st.sampled_from([0, 1]))
def test_entropy_coding(data, order):
    assert C.rans_decode(rans(data, order)) == data


def test_blocks_in_every_compression():
    import bz2
    import gzip
    import lzma

    raw = b"reads and more reads " * 50
    for method, packed in enumerate((raw, gzip.compress(raw), bz2.compress(raw), lzma.compress(raw), rans(raw, 1))):
        body = bytes([method, 4]) + C.put_number(7) + C.put_number(len(packed)) + C.put_number(len(raw)) + packed
        block = body + struct.pack("<I", __import__("zlib").crc32(body))
        assert C.read_block(C.Cursor(block)) == C.Block(4, 7, raw)
        with pytest.raises(ValueError):
            C.read_block(C.Cursor(block[:-1] + bytes([block[-1] ^ 1])))


def bits(text):
    return C.Streams(C.Bits(int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")), {})


def encoding(codec, *params):
    own = b"".join(p if isinstance(p, bytes) else C.put_number(p) for p in params)
    return C.put_number(codec) + C.put_number(len(own)) + own


@pytest.mark.parametrize(
    "description,text,want",
    [
        (encoding(6, 2, 4), "0101" "1111", [3, 13]),
        (encoding(3, C.put_numbers([65, 66, 67]), C.put_numbers([1, 2, 2])), "0" "10" "11" "0", [65, 66, 67, 65]),
        (encoding(3, C.put_numbers([9]), C.put_numbers([0])), "0", [9, 9]),
        (encoding(9, 1), "1" "010" "011" "00100", [0, 1, 2, 3]),
        (encoding(7, 0, 2), "000" "011" "1000" "110110", [0, 3, 4, 14]),
        (encoding(8, 0, 2), "001" "1010" "11000", [1, 6, 8]),
        (encoding(2, 0, 3), "00" "010" "011" "100", [0, 1, 2, 3]),
    ],
)
def test_encodings_of_numbers(description, text, want):
    s, get = bits(text), C.integer(C.Cursor(description))
    got = []
    for _ in want:
        got.append(get(s))
    assert got == want


# --- files ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def cram(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cram")
    write_reads(reads(spark), str(folder / "parts.cram"), HEADER, write_header=False)
    return merge_reads(str(folder / "parts.cram"), str(folder / "all.cram"), HEADER, "cram")


def test_round_trip_of_parts_and_of_a_merged_file(spark, cram, tmp_path):
    assert rows_of(read_cram(spark, cram)) == sorted(read_rows())
    assert read_sam_header(cram).text == HEADER.text and read_cram_header(cram).names == HEADER.names
    write_reads(reads(spark, 300, 3).repartition(3), str(tmp_path / "x.cram"), HEADER)
    assert rows_of(load_reads(spark, str(tmp_path / "x.cram"))) == sorted(read_rows(300))
    assert open(cram, "rb").read().endswith(C.END)
    write_reads(reads(spark).where("false"), str(tmp_path / "e.cram"), HEADER)
    assert load_reads(spark, str(tmp_path / "e.cram")).count() == 0


def test_containers_splits_and_intervals(spark, cram, monkeypatch, tmp_path):
    from helica.sources import cram as module

    header = SamHeader.of_contigs([("a", 10**6), ("b", 10**6)])
    r = lambda i, c: (f"r{i}", 0, 0 if c == "a" else 1, c, 1 + i, 10 + i, 9, "10M", -1, None, 0, 0, "ACGTACGTAC", "IIIIIIIIII", "")
    rows = [r(i, "a") for i in range(500)] + [r(i, "b") for i in range(500)]
    index = {"a": 0, "b": 1}
    data = C.file_start(header)
    for k in range(0, 1000, 100):
        data += C.encode_container(dict(zip(READ_COLUMNS, map(list, zip(*rows[k : k + 100])))), index, k)
    path = tmp_path / "x.cram"
    path.write_bytes(data + C.END)
    found = containers(str(path))
    assert [c.n_records for c in found] == [0] + [100] * 10 + [0] and found[1].ref == 0 and (found[2].start, found[2].span) == (101, 109)
    assert sum(n for _, n in splits(str(path), 2000)) == os.path.getsize(path) - found[1].offset
    df = read_cram(spark, str(path), split_size=500)
    assert df.rdd.getNumPartitions() == 10 and rows_of(df) == sorted(rows)
    some = read_cram(spark, str(path), parse_intervals("a:150-155"), split_size=500)
    assert some.rdd.getNumPartitions() == 1 and {x.start for x in some.collect()} == set(range(141, 156))
    with pytest.raises(Exception, match="not in the header"):
        read_cram(spark, str(path), parse_intervals("c:1-2")).count()
    assert module.CONTAINER_READS > 100


def test_reads_of_odd_shapes(spark, tmp_path):
    base = dict(zip(READ_COLUMNS, read_rows(1)[0]))
    odd = []
    for i, change in enumerate([{}, {"bases": "*", "quals": "*"}, {"quals": "*"}, {"bases": "ACGTNRYKM=" + "A" * 26}, {"tags": ""}, {"tags": "XA:A:q\tXf:f:1.5\tXB:B:c,-1,2\tXZ:Z:a b"}, {"cigar": "5S10M2D3I18M", "end": 530}, {"cigar": "3H2S4M1P2I5N28M1H", "end": 537}, {"mapq": 255, "insert_size": -7, "flags": 147}]):
        odd.append(tuple((base | {"read_name": f"odd{i}"} | change)[c] for c in READ_COLUMNS))
    df = spark.createDataFrame(odd, reads(spark, 1).schema)
    write_reads(df.coalesce(1), str(tmp_path / "x.cram"), HEADER)
    assert rows_of(read_cram(spark, str(tmp_path / "x.cram"))) == sorted(odd)
    for change in ({"contig": "nope"}, {"quals": "II"}):
        bad = base | change
        with pytest.raises(Exception, match="not in the header|qualities for"):
            write_reads(spark.createDataFrame([tuple(bad[c] for c in READ_COLUMNS)], df.schema), str(tmp_path / ("y" + next(iter(change)) + ".cram")), HEADER)
    key = read_cram(spark, str(tmp_path / "x.cram")).select("key", "ref_index", "start").first()
    assert key.key == key.ref_index << 32 | (key.start - 1)


def test_mixed_formats(spark, cram, tmp_path):
    os.symlink(cram, tmp_path / "x.cram")
    write_reads(reads(spark, 10), str(tmp_path / "y.bam"), HEADER)
    write_reads(reads(spark, 20, 2).repartition(2), str(tmp_path / "z.sam"), HEADER)
    write_reads(reads(spark, 20), str(tmp_path / "w.sam"), HEADER.sorted_by("unknown"))
    for name in ("y.bam", "z.sam", "w.sam"):
        for part in sorted(p for p in (tmp_path / name).iterdir() if p.name.startswith("part")):
            os.rename(part, tmp_path / f"{part.name}-{name}")
        for rest in (tmp_path / name).iterdir():
            rest.unlink()
        (tmp_path / name).rmdir()
    df = load_reads(spark, str(tmp_path))
    assert df.count() == 2002 + 22 + 42 + 42
    assert df.where("key is null").count() == 0 and df.select("read_name", "key").distinct().count() == df.select("read_name", "flags", "start").distinct().count()


def test_a_container_that_leaves_bases_to_its_reference(tmp_path):
    """Made by hand: relative positions, read groups, mates further down, codes in the core block, and every way to differ from the reference."""
    (tmp_path / "ref.fa").write_text(">other\nTTTT\n>one with more\nACGTACGTAC\nGTACGTACGT\n")
    header = SamHeader.parse("@HD\tVN:1.6\n@SQ\tSN:other\tLN:4\n@SQ\tSN:one\tLN:20\n@RG\tID:g0\n@RG\tID:g1\n")
    number = C.put_number
    ext = lambda n: encoding(1, n)
    one = lambda v: encoding(3, C.put_numbers([v]), C.put_numbers([0]))
    # Two reads of one template: the first with a substitution, a deletion and a quality, the second as the reference.
    core = "0" + "1"  # which read group, one bit each
    blocks = {1: number(0x1 | 0x40) + number(0x1 | 0x80 | 0x10), 2: number(C.DOWNSTREAM) + number(0), 3: number(2) + number(5), 4: b"first\0", 5: number(0), 6: number(3) + number(0), 7: b"XDQ", 8: number(2) + number(2) + number(1), 9: b"\2", 10: number(3), 11: b"\x20", 12: number(60) + number(7), 13: b"\5\7"}
    series = {"BF": ext(1), "CF": ext(2), "RL": one(8), "AP": ext(3), "RG": encoding(6, 0, 1), "RN": encoding(5, b"\0", 4), "NF": ext(5), "TL": one(0), "FN": ext(6), "FC": ext(7), "FP": ext(8), "BS": ext(9), "DL": ext(10), "QS": ext(11), "MQ": ext(12)}
    blocks[4] = b"first\0second\0"
    tag = ord("N") << 16 | ord("M") << 8 | ord("C")
    tags = number(1) + number(tag) + encoding(4, one(1), ext(13))
    kept = number(5) + b"RN\1AP\1RR\1SM" + bytes([0x1B] * 5) + b"TD" + number(4) + b"NMC\0"
    coded = number(len(series)) + b"".join(k.encode() + v for k, v in series.items())
    first = C.block_bytes(C.COMPRESSION_HEADER, 0, b"".join(number(len(x)) + x for x in (kept, coded, tags)))
    head = b"".join(map(number, (1, 1, 20, 2))) + C.put_long(0) + number(len(blocks) + 1) + C.put_numbers(list(blocks)) + number(-1) + bytes(16)
    data = first + C.block_bytes(C.SLICE_HEADER, 0, head) + C.block_bytes(C.CORE, 0, int(core.ljust(8, "0"), 2).to_bytes(1, "big")) + b"".join(C.block_bytes(C.EXTERNAL, n, b) for n, b in blocks.items())
    a, b = C.decode_container(data, header, C.Reference(str(tmp_path / "ref.fa")))
    # From position 3: G, then T replaced by the third of its others (G), then 3 deleted behind the third base ...
    assert (a["read_name"], a["start"], a["cigar"], a["bases"], a["end"], a["mapq"]) == ("first", 3, "3M3D5M", "GGAACGTA", 13, 60)
    assert a["quals"] == "????A???" and b["quals"] == "*"
    assert (b["read_name"], b["start"], b["cigar"], b["bases"], b["contig"]) == ("second", 8, "8M", "TACGTACG", "one")
    assert a["tags"] == "NM:i:5\tRG:Z:g0" and b["tags"] == "NM:i:7\tRG:Z:g1"
    assert (a["mate_contig"], a["mate_start"], a["insert_size"], b["mate_start"], b["insert_size"]) == ("one", 8, 13, 3, -13)
    assert a["flags"] & C.MATE_REVERSED and not b["flags"] & C.MATE_REVERSED
    with pytest.raises(ValueError, match="reference"):
        list(C.decode_container(data, header))
