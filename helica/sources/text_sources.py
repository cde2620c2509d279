"""Data sources for text in block gzip, FASTQ and FASTA."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from helica.functions.intervals import merge_intervals, parse_intervals
from helica.sources import bgzf
from helica.sources.bam_index import LinearIndex
from helica.sources.bcf import PartWriter
from helica.sources.files import SPLIT_BYTES, ByteRange, byte_ranges, exists, expand, open_file, sliced_lines

ROWS = 4096


def batches_of(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    schema = pa.schema(list(zip(names, kinds)))
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)


class _Reader(DataSourceReader):
    """Reads ranges of files; compressed ones as a whole unless they are block gzip and ``blocks`` is set."""

    blocks = False

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitSize", SPLIT_BYTES))
        self.check(options)

    def check(self, options: dict) -> None:
        pass

    def partitions(self) -> list[ByteRange]:
        parts: list[ByteRange] = []
        for f in expand(self.path):
            kind = bgzf.sniff(f)
            parts += byte_ranges(f, self.split, kind == "plain" or (self.blocks and kind == "bgzf"))
        return parts


def all_lines(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of a range of a plain file, or of a whole compressed one."""
    if bgzf.sniff(part.path) == "plain":
        yield from sliced_lines(part.path, part.start, part.end)
        return
    if part.start:
        raise ValueError(f"{part.path} cannot be split")
    at = 0
    with open_file(part.path) as f, gzip.GzipFile(fileobj=f) as text:
        for line in text:
            yield at, line.removesuffix(b"\n").removesuffix(b"\r")
            at += len(line)


class BgzfLines(DataSource):
    """``offset`` (virtual) and ``value`` of the lines of block gzip files, with ``intervals`` only those a tabix index does not rule out; writing takes ``value``, with ``header`` and ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return BgzfLinesReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BgzfLinesWriter(self.options, overwrite)


class BgzfLinesReader(_Reader):
    blocks = True
    intervals: list | None = None

    def check(self, options: dict) -> None:
        self.intervals = parse_intervals(options.get("intervals"))

    def partitions(self) -> list[ByteRange]:
        """With ``intervals`` and a ``.tbi`` beside a file, only ranges that may hold their lines."""
        parts = super().partitions()
        if self.intervals is None:
            return parts
        wanted: dict[str, list[tuple[int, int]] | None] = {}
        for p in parts:
            if p.path not in wanted:
                wanted[p.path] = None
                if exists(p.path + ".tbi"):
                    index = LinearIndex.read(p.path + ".tbi")
                    spans = [(index.names.index(i.contig), i.start, i.stop) for i in merge_intervals(self.intervals) if i.contig in index.names]
                    wanted[p.path] = index.chunks(spans)
        touches = lambda p, chunks: any(a >> 16 < p.end + bgzf.MAX_BLOCK and b >> 16 >= p.start - bgzf.MAX_BLOCK for a, b in chunks)
        return [p for p in parts if wanted[p.path] is None or touches(p, wanted[p.path])]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        lines = bgzf.bgzf_lines(part.path, part.start, part.end, part.size) if bgzf.sniff(part.path) == "bgzf" else all_lines(part)
        yield from batches_of(((o, v.decode()) for o, v in lines), ["offset", "value"], [pa.int64(), pa.string()])


class BgzfLinesWriter(PartWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.header, self.suffix = options.get("header", ""), options.get("suffix", ".bgz")

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        if self.header:
            yield self.header.encode()
        for batch in batches:
            for line in batch.column(batch.schema.get_field_index("value")).to_pylist():
                yield line.encode() + b"\n"


class FastqSource(DataSource):
    """Records of FASTQ files: file, offset, key (the name), sequence, quality. Options ``path``, ``splitSize``, ``maxLine``."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, offset long, key string, sequence string, quality string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


class FastqReader(_Reader):
    #: Longest line of a record that is accepted; none by default, as long reads have no bound.
    max_line: int | None = None

    def check(self, options: dict) -> None:
        self.max_line = int(options["maxLine"]) if "maxLine" in options else None

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        for at, fields in fastq_batches(part):
            if self.max_line is not None and max((pc.max(pc.binary_length(f)).as_py() or 0 for f in fields), default=0) > self.max_line:
                raise ValueError(f"{part.path}: line of more than {self.max_line} bytes")
            file = pa.repeat(pa.scalar(part.path), len(at))
            yield pa.RecordBatch.from_arrays([file, at, *fields], ["file", "offset", "key", "sequence", "quality"])


def fastq_batches(part: ByteRange, chunk: int = 4 << 20) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """Offsets and fields of the records whose first line begins in the range, cut out of whole buffers.

    Compressed files, and files with other line ends than LF or blank lines, are gone
    through line by line instead.
    """
    start = part.start
    if start:
        first = next(fastq_records(part), None)
        if first is None:
            return
        start = first[0]
    if bgzf.sniff(part.path) != "plain":
        yield from _by_lines(part, start)
        return
    with open_file(part.path) as f:
        f.seek(start)
        rest = b""
        while start < part.end:
            read = f.read(chunk)
            data = rest + read
            if not read and data and not data.endswith(b"\n"):
                data += b"\n"
            raw = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(raw == 10)
            ends = ends[: len(ends) // 4 * 4]
            if not len(ends):
                if data.strip() and not read:
                    yield from _by_lines(part, start)
                if not read:
                    return
                rest, chunk = data, 2 * chunk
                continue
            begins = np.concatenate([[0], ends[:-1] + 1])
            good = (raw[begins[0::4]] == 64) & (raw[begins[2::4]] == 43)
            if not good.all() or b"\r" in data:
                yield from _by_lines(part, start)
                return
            keep = int(np.searchsorted(begins[0::4] + start, part.end))
            offsets = np.append(begins, ends[-1] + 1).astype(np.int32)
            lines = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            line = lambda k, cut: pc.binary_slice(lines.take(pa.array(np.arange(k, 4 * keep, 4))), cut, -1).cast(pa.string())
            if keep:
                yield pa.array(begins[: 4 * keep : 4] + start), [line(0, 1), line(1, 0), line(3, 0)]
            if keep < len(begins) // 4:
                return
            rest = data[ends[-1] + 1 :]
            start += int(ends[-1]) + 1


def _by_lines(part: ByteRange, start: int) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """The same, a record at a time."""

    def rows() -> Iterator[tuple]:
        for at, name, bases, plus, quality in fastq_records(part, start):
            if not name.startswith(b"@") or not plus.startswith(b"+"):
                raise ValueError(f"{part.path}: no FASTQ record at {at}")
            yield at, name[1:].decode(), bases.decode(), quality.decode()

    for batch in batches_of(rows(), ["at", "key", "sequence", "quality"], [pa.int64(), pa.string(), pa.string(), pa.string()]):
        yield batch.column(0), batch.columns[1:]


def fastq_records(part: ByteRange, known: int | None = None) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """The records whose first line begins in the range; the last is read to its end. ``known`` is where a record begins, if that is known.

    A range in the middle of a file begins at the first line with ``@`` whose
    second next line begins with ``+``; a quality may begin with ``@``, and then the
    line after the next is a sequence.
    """
    plain = bgzf.sniff(part.path) == "plain"
    lines = sliced_lines(part.path, known or part.start, part.size) if plain else all_lines(part)
    held: list[tuple[int, bytes]] = []
    synced = part.start == 0 or known is not None
    for at, line in lines:
        if not line and not held:
            continue
        held.append((at, line))
        if not synced:
            while len(held) >= 4 and not _starts(held):
                held.pop(0)
            if len(held) < 4:
                if held and held[0][0] >= part.end:
                    return
                continue
            synced = True
        if held[0][0] >= part.end and plain:
            return
        if len(held) == 4:
            yield held[0][0], held[0][1], held[1][1], held[2][1], held[3][1]
            held = []
    if held and synced:
        raise ValueError(f"{part.path} ends inside a record")


def _starts(held: list[tuple[int, bytes]]) -> bool:
    name, bases, plus, quality = (line for _, line in held[:4])
    return name.startswith(b"@") and plus.startswith(b"+") and len(bases) == len(quality)


class FastaSource(DataSource):
    """Lines of FASTA sequences: key, index_sequence (description), position, sequence. Options ``path``, ``splitSize``, ``maxLine``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "key string, index_sequence string, position int, sequence string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(_Reader):
    max_line: int | None = None

    def check(self, options: dict) -> None:
        self.max_line = int(options["maxLine"]) if "maxLine" in options else None
        if len(expand(self.path)) > 1:
            raise ValueError("the fasta source reads one file")

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        yield from batches_of(fasta_rows(part, self.max_line), ["key", "index_sequence", "position", "sequence"], [pa.string(), pa.string(), pa.int32(), pa.string()])


def fasta_rows(part: ByteRange, max_line: int | None = None) -> Iterator[tuple[str, str, int, str]]:
    """One row a line of the sequences whose ``>`` line begins in the range, each read to its end.

    The position of a line is 1 for the first and then rises by the bytes before
    it, line ends included. The key is description and position, joined.
    """
    plain = bgzf.sniff(part.path) == "plain"
    lines = sliced_lines(part.path, part.start, part.size) if plain else all_lines(part)
    name, origin = None, 0
    first = None
    for at, line in lines:
        if line.startswith(b">"):
            if plain and at >= part.end:
                return
            name, first = line[1:].decode(), None
        elif name is None and part.start == 0 and line:
            raise ValueError(f"{part.path} does not begin with a description")
        elif name is not None and line:
            if max_line is not None and len(line) > max_line:
                raise ValueError(f"{part.path}: line of more than {max_line} bytes at {at}")
            if first is None:
                first, origin = at, at
            position = at - origin + 1
            yield f"{name}{position}", name, position, line.decode()
        elif plain and name is None and at >= part.end:
            return


