"""BCF 2: binary variants as lines of VCF text, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from helica.functions.names import parse_boolean
from helica.sources import bgzf
from helica.sources.files import SPLIT_BYTES, create, expand, open_file, size_of, stamp
from helica.sources.parts import PartFile, PartFolder
from helica.sources.records import Kind, VirtualRange, record_slices, resolve
from helica.sources.vcf import VcfHeader

#: Fixed values of the format: widths of whole numbers by type, and their values for missing and end of vector.
INTS = {1: ("b", 1), 2: ("h", 2), 3: ("i", 4)}
MISSING = {1: -(2**7), 2: -(2**15), 3: -(2**31)}
END = {1: -(2**7) + 1, 2: -(2**15) + 1, 3: -(2**31) + 1}
FLOAT, CHAR = 5, 7
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002


@dataclass
class Dictionary:
    """Numbers of strings (filters, INFO and FORMAT ids) and of contigs."""

    strings: dict[int, str] = field(default_factory=lambda: {0: "PASS"})
    contigs: dict[int, str] = field(default_factory=dict)
    types: dict[tuple[str, str], str] = field(default_factory=dict)

    @classmethod
    def of(cls, header: VcfHeader) -> Dictionary:
        import re

        d = cls()
        for line in header.text.splitlines():
            m = re.match(r"##(contig|FILTER|INFO|FORMAT)=<(.*)>\s*$", line)
            if not m:
                continue
            name = re.search(r"(?:^|,)ID=([^,]+)", m[2])[1]
            number = re.search(r"(?:^|,)IDX=(\d+)", m[2])
            if kind := re.search(r"(?:^|,)Type=(\w+)", m[2]):
                d.types[m[1], name] = kind[1]
            table = d.contigs if m[1] == "contig" else d.strings
            if name not in table.values():
                table[int(number[1]) if number else max(table, default=-1) + 1] = name
        return d

    def numbers(self, which: str) -> dict[str, int]:
        return {v: k for k, v in getattr(self, which).items()}


def header_of(data: bytes) -> tuple[VcfHeader, int] | None:
    """Header and its length in bytes; None if ``data`` ends before it does."""
    if data[:3] != b"BCF" or len(data) < 9:
        raise ValueError("not a BCF file")
    n = struct.unpack_from("<I", data, 5)[0]
    if len(data) < 9 + n:
        return None
    return VcfHeader.parse(data[9 : 9 + n].rstrip(b"\0").decode()), 9 + n


def read_bcf_header(path: str) -> tuple[VcfHeader, int]:
    """The header, and the virtual offset of the first record (plain offset in an uncompressed file)."""
    return _header_of_file(path, stamp(path))


@lru_cache(maxsize=64)
def _header_of_file(path: str, _stamp: tuple) -> tuple[VcfHeader, int]:
    if bgzf.sniff(path) == "plain":
        with open_file(path) as f:
            size = struct.unpack("<I", f.read(9)[5:9])[0]
            f.seek(0)
            return header_of(f.read(9 + size))
    data, marks = bytearray(), []
    for address, n, block in bgzf.Blocks(path):
        marks.append((len(data), address, address + n))
        data += block
        if len(data) >= 9 and (data[:3] != b"BCF" or len(data) >= 9 + struct.unpack_from("<I", data, 5)[0]):
            header, length = header_of(bytes(data))
            begin, where, after = marks[-1]
            return header, after << 16 if length == len(data) else (where << 16) | (length - begin)
    raise ValueError(f"{path} ends inside its header")


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """Type, count and where the values start."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        (n,), at = _ints(data, at)
    return kind, n, at


def _ints(data: bytes, at: int) -> tuple[list[int | None], int]:
    kind, n, at = _typed(data, at)
    if kind == 0:
        return [], at
    code, width = INTS[kind]
    values = struct.unpack_from(f"<{n}{code}", data, at)
    return [None if v == MISSING[kind] else v for v in values if v != END[kind]], at + n * width


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.6g}"


def _values(data: bytes, at: int, kind: int, n: int) -> tuple[list[str], int]:
    """The values of one vector as text."""
    if kind == 0:
        return [], at
    if kind == CHAR:
        text = data[at : at + n].rstrip(b"\0").decode()
        return ([text] if text else []), at + n
    if kind == FLOAT:
        bits = struct.unpack_from(f"<{n}I", data, at)
        floats = struct.unpack_from(f"<{n}f", data, at)
        return ["." if b == FLOAT_MISSING else _number(x) for b, x in zip(bits, floats) if b != FLOAT_END], at + 4 * n
    code, width = INTS[kind]
    values = struct.unpack_from(f"<{n}{code}", data, at)
    return ["." if v == MISSING[kind] else str(v) for v in values if v != END[kind]], at + n * width


@lru_cache(maxsize=1 << 16)
def _genotype(values: tuple[int, ...], kind: int) -> str:
    """GT numbers as text: (allele + 1) << 1, and a low bit for phased."""
    out = ""
    for i, n in enumerate(v for v in values if v != END[kind]):
        if n == MISSING[kind]:
            out += "/." if i else "."
            continue
        out += ("|" if n & 1 else "/") * (i > 0) + (str((n >> 1) - 1) if n >> 1 else ".")
    return out or "."


@lru_cache(maxsize=1 << 16)
def _numbers(values: tuple[int, ...], kind: int) -> str:
    return ",".join("." if v == MISSING[kind] else str(v) for v in values if v != END[kind]) or "."


def _cells(data: bytes, at: int, kind: int, n: int, samples: int, is_genotype: bool) -> tuple[list[str], int]:
    """The texts of one FORMAT field of all samples, taken from one stretch of numbers."""
    if kind in INTS and n:
        code, width = INTS[kind]
        flat = struct.unpack_from(f"<{n * samples}{code}", data, at)
        text = _genotype if is_genotype else _numbers
        return [text(flat[i : i + n], kind) for i in range(0, n * samples, n)], at + n * samples * width
    out = []
    for _ in range(samples):
        values, at = _values(data, at, kind, n)
        out.append(",".join(values) or ".")
    return out, at


def decode_fields(data: bytes, at: int, d: Dictionary, n_header_samples: int) -> tuple[str, int, str, list[str], str, list[str], list[str], list[str]]:
    """Contig, position, id, alleles, quality, filters, INFO entries, and the FORMAT column with those of the samples; all but the position as the text that VCF has."""
    shared = struct.unpack_from("<I", data, at)[0]
    chrom, pos, _ = struct.unpack_from("<iii", data, at + 8)
    qual_bits, counts, samples = struct.unpack_from("<III", data, at + 20)
    n_info, n_allele, n_fmt, n_sample = counts & 0xFFFF, counts >> 16, samples >> 24, samples & 0xFFFFFF
    p = at + 32
    kind, n, p = _typed(data, p)
    name = data[p : p + n].decode()
    p += n
    alleles = []
    for _ in range(n_allele):
        kind, n, p = _typed(data, p)
        alleles.append(data[p : p + n].decode())
        p += n
    filters, p = _ints(data, p)
    info = []
    for _ in range(n_info):
        (key,), p = _ints(data, p)
        kind, n, p = _typed(data, p)
        values, p = _values(data, p, kind, n)
        field_name = d.strings[key]
        flag = kind == 0 or d.types.get(("INFO", field_name)) == "Flag"
        info.append(field_name if flag else f"{field_name}={','.join(values) or '.'}")
    qual = "." if qual_bits == FLOAT_MISSING else _number(struct.unpack_from("<f", data, at + 20)[0])
    calls: list[str] = []
    if n_fmt:
        p, keys, fields = at + 8 + shared, [], []
        for _ in range(n_fmt):
            (key,), p = _ints(data, p)
            keys.append(d.strings[key])
            kind, n, p = _typed(data, p)
            texts, p = _cells(data, p, kind, n, n_sample, keys[-1] == "GT")
            fields.append(texts)
        calls = [":".join(keys), *map(":".join, zip(*fields))]
    elif n_header_samples:
        calls = ["."] * (1 + n_header_samples)
    return d.contigs[chrom], pos + 1, name or ".", alleles, qual, [d.strings[f] for f in filters], info, calls


def decode_record(data: bytes, at: int, d: Dictionary, n_header_samples: int) -> str:
    """One record as a line of VCF text."""
    contig, pos, name, alleles, qual, filters, info, calls = decode_fields(data, at, d, n_header_samples)
    return "\t".join([contig, str(pos), name, alleles[0], ",".join(alleles[1:]) or ".", qual, ";".join(filters) or ".", ";".join(info) or ".", *calls])


TEXTS = pa.list_(pa.string())
#: The columns of typed variants, but those that are made from others.
VARIANT_COLUMNS = {
    "contig": pa.string(), "start": pa.int32(), "end": pa.int32(), "id": pa.string(), "alleles": TEXTS, "qual": pa.float64(), "filters": TEXTS,
    "attributes": pa.map_(pa.string(), TEXTS), "info_raw": pa.string(), "n_genotypes": pa.int32(), "format": pa.string(), "genotypes_raw": pa.string(),
}
VARIANT_SCHEMA = "contig string, start int, end int, id string, alleles array<string>, qual double, filters array<string>, attributes map<string,array<string>>, info_raw string, n_genotypes int, format string, genotypes_raw string"


def typed_batch(data: bytes, offsets: list[int], d: Dictionary, n_header_samples: int) -> pa.RecordBatch:
    """Records as typed variants, the same as their lines parsed."""
    rows = []
    for o in offsets:
        contig, pos, name, alleles, qual, filters, info, calls = decode_fields(data, o, d, n_header_samples)
        attributes: dict[str, list[str]] = {}
        for entry in info:
            key, eq, value = entry.partition("=")
            attributes.setdefault(key, value.split(",") if eq else [])
        ends = attributes.get("END", [""])[0:1]
        end = int(ends[0]) if ends and ends[0].isdigit() else pos + len(alleles[0]) - 1
        passed = None if not filters else [] if filters == ["PASS"] else filters
        rows.append((contig, pos, end, None if name == "." else name, alleles, None if qual == "." else float(qual), passed, list(attributes.items()), ";".join(info) or ".", max(len(calls) - 1, 0), calls[0] if calls else None, "\t".join(calls[1:]) if len(calls) > 1 else None))
    columns = list(zip(*rows)) or [[] for _ in VARIANT_COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, VARIANT_COLUMNS.values())], list(VARIANT_COLUMNS))




def _put_typed(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _put_ints([n])


def _width(values: list[int]) -> int:
    low, high = min(values, default=0), max(values, default=0)
    return 1 if low >= -120 and high <= 127 else 2 if low >= -32760 and high <= 32767 else 3


def _put_ints(values: list[int | None], kind: int | None = None, length: int | None = None, head: bool = True) -> bytes:
    kind = kind or _width([v for v in values if v is not None])
    length = len(values) if length is None else length
    full = [MISSING[kind] if v is None else v for v in values] + [END[kind]] * (length - len(values))
    return (_put_typed(kind, length) if head else b"") + struct.pack(f"<{length}{INTS[kind][0]}", *full)


def _put_floats(values: list[float | None], length: int | None = None, head: bool = True) -> bytes:
    length = len(values) if length is None else length
    bits = [struct.pack("<I", FLOAT_MISSING) if v is None else struct.pack("<f", v) for v in values] + [struct.pack("<I", FLOAT_END)] * (length - len(values))
    return (_put_typed(FLOAT, length) if head else b"") + b"".join(bits)


def _put_text(text: str, length: int | None = None, head: bool = True) -> bytes:
    raw = text.encode()
    length = len(raw) if length is None else length
    return (_put_typed(CHAR, length) if head else b"") + raw.ljust(length, b"\0")


def _alleles(gt: str) -> list[int]:
    import re

    out = []
    for sign, a in re.findall(r"([/|]?)(\.|\d+)", gt):
        out.append(((int(a) + 1) << 1 if a != "." else 0) | (sign == "|"))
    return out


def _columns_of(kind: str, texts: list[str], key: str) -> bytes:
    """One FORMAT field of all samples: vectors of equal length."""
    if key == "GT":
        rows = [_alleles(t) for t in texts]
    elif kind in ("Integer", "Float"):
        cast = int if kind == "Integer" else float
        rows = [[None if v == "." else cast(v) for v in t.split(",")] for t in texts]
    else:
        length = max((len(t.encode()) for t in texts), default=0)
        return _put_typed(CHAR, length) + b"".join(_put_text(t, length, False) for t in texts)
    length = max((len(r) for r in rows), default=0)
    if kind == "Float" and key != "GT":
        return _put_typed(FLOAT, length) + b"".join(_put_floats(r, length, False) for r in rows)
    width = _width([v for r in rows for v in r if v is not None])
    return _put_typed(width, length) + b"".join(_put_ints(r, width, length, False) for r in rows)


def encode_line(line: str, d: Dictionary, contigs: dict[str, int], strings: dict[str, int]) -> bytes:
    """One line of VCF text as a record. Contigs and ids have to be in the header."""
    f = line.split("\t")
    alleles = [f[3], *([] if f[4] == "." else f[4].split(","))]
    info = [] if f[7] == "." else [e.partition("=") for e in f[7].split(";") if e]
    ends = next((int(v) for k, _, v in info if k == "END" and v.isdigit()), None)
    span = ends - int(f[1]) + 1 if ends else len(f[3])
    filters = [] if f[6] == "." else [strings[x] for x in f[6].split(";")]
    keys = f[8].split(":") if len(f) > 9 and f[8] != "." else []
    n_sample = len(f) - 9 if len(f) > 9 else 0
    qual = struct.pack("<I", FLOAT_MISSING) if f[5] == "." else struct.pack("<f", float(f[5]))
    shared = struct.pack("<iii", contigs[f[0]], int(f[1]) - 1, span) + qual + struct.pack("<II", len(alleles) << 16 | len(info), len(keys) << 24 | n_sample)
    shared += _put_text("" if f[2] == "." else f[2]) + b"".join(map(_put_text, alleles))
    shared += _put_ints(filters) if filters else b"\0"
    for key, eq, value in info:
        kind = d.types.get(("INFO", key), "String")
        shared += _put_ints([strings[key]])
        if not eq or kind == "Flag":
            shared += b"\0"
        elif kind == "Integer":
            shared += _put_ints([None if v == "." else int(v) for v in value.split(",")])
        elif kind == "Float":
            shared += _put_floats([None if v == "." else float(v) for v in value.split(",")])
        else:
            shared += _put_text(value)
    cells = [c.split(":") for c in f[9:]]
    own = b"".join(_put_ints([strings[k]]) + _columns_of(d.types.get(("FORMAT", k), "String"), [c[i] if i < len(c) else "." for c in cells], k) for i, k in enumerate(keys))
    return struct.pack("<II", len(shared), len(own)) + shared + own


def header_bytes(header: VcfHeader) -> bytes:
    text = header.text.encode() + b"\0"
    return b"BCF\2\2" + struct.pack("<I", len(text)) + text


def bcf_kind(d: Dictionary, n_samples: int) -> Kind:
    top = max(d.contigs, default=-1)

    def plausible(data: bytes, at: int) -> bool:
        if at + 36 > len(data):
            return False
        shared, own = struct.unpack_from("<II", data, at)
        chrom, pos, span = struct.unpack_from("<iii", data, at + 8)
        counts, samples = struct.unpack_from("<II", data, at + 24)
        ok = 24 < shared < 1 << 28 and own < 1 << 31 and 0 <= chrom <= top and pos >= -1 and span >= 0 and counts >> 16 >= 1 and samples & 0xFFFFFF == n_samples
        return ok and data[at + 32] & 15 == CHAR

    return Kind(36, lambda data, at: 8 + sum(struct.unpack_from("<II", data, at)), plausible)


class BcfSource(DataSource):
    """Lines of VCF text from BCF files (``path``, ``splitSize``), with ``typed`` typed variants instead; and BCF files from lines (``header``, ``writeHeader``)."""

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return VARIANT_SCHEMA if parse_boolean(self.options.get("typed"), False) else "value string"

    def reader(self, schema) -> DataSourceReader:
        return BcfReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BcfWriter(self.options, overwrite)


class BcfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitSize", SPLIT_BYTES))
        self.typed = parse_boolean(options.get("typed"), False)

    def partitions(self) -> list[VirtualRange]:
        parts = []
        for path in expand(self.path):
            size = size_of(path)
            step = max(size, 1) if bgzf.sniff(path) == "plain" else self.split
            parts += [VirtualRange(path, a << 16, min(a + step, size) << 16, size, False) for a in range(0, size, step)]
        return parts

    def read(self, part: VirtualRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        header, begin = read_bcf_header(part.path)
        d = Dictionary.of(header)
        n = len(header.samples)
        if bgzf.sniff(part.path) == "plain":
            slices = _plain_slices(part.path, begin)
        else:
            kind = bcf_kind(d, n)
            slices = ((data, offsets.tolist()) for data, offsets, _ in record_slices(part.path, *resolve(part, kind, begin), kind))
        for data, offsets in slices:
            if self.typed:
                yield typed_batch(data, offsets, d, n)
                continue
            yield pa.RecordBatch.from_pydict({"value": [decode_record(data, o, d, n) for o in offsets]})


def _plain_slices(path: str, begin: int) -> Iterator[tuple[bytes, list[int]]]:
    with open_file(path) as f:
        f.seek(begin)
        rest = b""
        while chunk := f.read(4 << 20):
            data, at, offsets = rest + chunk, 0, []
            while at + 8 <= len(data):
                n = 8 + sum(struct.unpack_from("<II", data, at))
                if at + n > len(data):
                    break
                offsets.append(at)
                at += n
            yield data, offsets
            rest = data[at:]
        if rest:
            raise ValueError(f"{path} ends inside a record")


class PartWriter(PartFolder):
    """Base of writers whose files are pieces of bytes, in block gzip unless ``packed`` is false."""

    packed = True

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> PartFile:
        part, buffer = self.new_part(), bytearray()
        with create(part.path) as out:
            for piece in self.pieces(batches):
                if not self.packed:
                    out.write(piece)
                    continue
                buffer += piece
                whole = len(buffer) // bgzf.PAYLOAD * bgzf.PAYLOAD
                if whole:
                    out.write(bgzf.compress(bytes(buffer[:whole])))
                    del buffer[:whole]
            out.write(bgzf.compress(bytes(buffer)))  # nothing where pieces are not packed
        return part


class BcfWriter(PartWriter):
    suffix = ".bcf"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        if not options.get("header"):
            raise ValueError("writing BCF needs a header")
        self.header = VcfHeader.parse(options["header"])

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        d = Dictionary.of(self.header)
        contigs, strings = d.numbers("contigs"), d.numbers("strings")
        if self.with_header:
            yield header_bytes(self.header)
        for batch in batches:
            for line in batch.column(0).to_pylist():
                yield encode_line(line, d, contigs, strings)


