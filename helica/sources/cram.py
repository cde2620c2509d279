"""The ``cram`` data source: scan along containers, and writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from helica.functions.hashing import read_hashes
from helica.functions.intervals import merge_intervals, parse_intervals
from helica.functions.keys import NO_POSITION, UNMAPPED
from helica.functions.names import parse_boolean
from helica.sources.bcf import PartWriter
from helica.sources.cram_codec import END, Cursor, Reference, decode_container, encode_container, file_start, read_block
from helica.sources.files import SPLIT_BYTES, expand, open_file, size_of, stamp
from helica.sources.sam import READ_COLUMNS, READ_SCHEMA, SamHeader

#: Reads of a written container.
CONTAINER_READS = 10_000


@dataclass(frozen=True)
class Container:
    """``data`` is where its blocks begin; ``ref`` is -2 where it holds several references."""

    offset: int
    length: int
    n_records: int
    data: int = 0
    ref: int = -2
    start: int = 0
    span: int = 0


def containers(path: str) -> list[Container]:
    """All containers after the file definition, the header's first; only their headers are read."""
    size, found = size_of(path), []
    with open_file(path) as f:
        top = f.read(26)
        if top[:4] != b"CRAM":
            raise ValueError(f"{path} is not a CRAM file")
        major, at = top[4], 26
        while at < size:
            f.seek(at)
            head = f.read(1024)
            length = struct.unpack_from("<i", head)[0]
            c = Cursor(head, 4)
            ref, start, span, records = (c.number() for _ in range(4))
            c.long() if major >= 3 else c.number()
            c.long()
            c.number()  # blocks
            marks = c.number()
            while len(head) < c.at + 5 * marks + 4 and len(head) < size - at:
                head += f.read(1 << 16)
            c.data = head
            for _ in range(marks):
                c.number()
            data = at + c.at + (4 if major >= 3 else 0)
            found.append(Container(at, data + length - at, records, data, ref, start, span))
            at = data + length
    return found


def container_splits(offsets: list[int], size: int, split: int) -> list[tuple[int, int]]:
    """(start, length) of splits of about ``split`` bytes, both ends moved up to the next container; empty ones go."""
    marks = [*offsets, size]

    def up(x: int) -> int:
        return next((m for m in marks if m >= x), size)

    ends = [(up(a), up(min(a + split, size))) for a in range(0, size, split)]
    return [(a, b - a) for a, b in ends if b > a]


def splits(path: str, split: int) -> list[tuple[int, int]]:
    """Splits of a file along its containers of records; the header's container is in none."""
    return container_splits([c.offset for c in containers(path)[1:]], size_of(path), split)


def read_cram_header(path: str) -> SamHeader:
    """The SAM header in the first container."""
    return _header_of_file(path, stamp(path))


@lru_cache(maxsize=64)
def _header_of_file(path: str, _stamp: tuple) -> SamHeader:
    first = containers(path)[0]
    with open_file(path) as f:
        f.seek(first.data)
        text = read_block(Cursor(f.read(first.offset + first.length - first.data))).data
    n = struct.unpack_from("<i", text)[0]
    return SamHeader.parse(text[4 : 4 + n].rstrip(b"\0").decode())


@dataclass
class ContainerRange(InputPartition):
    """Containers of records next to each other."""

    path: str
    containers: tuple


class CramSource(DataSource):
    """Reads of CRAM 3 files. Options: ``path``, ``reference`` (a FASTA file, for files that leave bases to it), ``intervals``
    (containers that hold none are not read), ``splitSize``. Writing: ``header`` (SAM text) and ``writeHeader``."""

    @classmethod
    def name(cls) -> str:
        return "cram"

    def schema(self) -> str:
        return READ_SCHEMA + ", key long"

    def reader(self, schema) -> DataSourceReader:
        return CramReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CramWriter(self.options, overwrite)


class CramReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.reference = options["path"], options.get("reference")
        self.split = int(options.get("splitSize", SPLIT_BYTES))
        self.intervals = parse_intervals(options.get("intervals"))
        self.unplaced = parse_boolean(options.get("unplaced"), False)

    def partitions(self) -> list[ContainerRange]:
        """About ``splitSize`` bytes of containers a task."""
        parts = []
        for path in expand(self.path):
            held, size = [], 0
            for c in self._wanted(path):
                held.append(c)
                size += c.length
                if size >= self.split:
                    parts.append(ContainerRange(path, tuple(held)))
                    held, size = [], 0
            if held:
                parts.append(ContainerRange(path, tuple(held)))
        return parts

    def _wanted(self, path: str) -> list[Container]:
        found = [c for c in containers(path)[1:] if c.n_records]
        if self.intervals is None:
            return found
        names = read_cram_header(path).names
        missing = {i.contig for i in self.intervals} - set(names)
        if missing:
            raise ValueError(f"contigs are not in the header: {sorted(missing)}")
        spans = [(names.index(i.contig), i.start, i.stop) for i in merge_intervals(self.intervals)]
        return [c for c in found if c.ref == -2 or (c.ref == -1 and self.unplaced) or any(c.ref == r and (not c.span or (c.start <= b and c.start + c.span - 1 >= a)) for r, a, b in spans)]

    def read(self, part: ContainerRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no containers at all
            return
        header = read_cram_header(part.path)
        reference = Reference(self.reference) if self.reference else None
        for c in part.containers:
            with open_file(part.path) as f:
                f.seek(c.data)
                data = f.read(c.offset + c.length - c.data)
            rows = list(decode_container(data, header, reference))
            if rows:
                yield as_batch(rows)


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    """Decoded reads with their sortable key."""
    whole = {"flags", "ref_index", "start", "end", "mapq", "mate_ref_index", "mate_start", "insert_size"}
    arrays = {c: pa.array([r[c] for r in rows], pa.int32() if c in whole else pa.string()) for c in READ_COLUMNS}
    flags, ref, start = (arrays[c].to_numpy().astype(np.int64) for c in ("flags", "ref_index", "start"))
    key = np.where(start < 1, start - 1, (ref << 32) | (start - 1))
    lost = np.flatnonzero(((flags & UNMAPPED) != 0) | (ref < 0) | (start < 0))
    if len(lost):
        some = [rows[i] for i in lost]
        key[lost] = (NO_POSITION << 32) | read_hashes(*([r[c] for r in some] for c in ("read_name", "bases", "quals", "cigar")))
    return pa.RecordBatch.from_arrays([*arrays.values(), pa.array(key)], [*arrays, "key"])


class CramWriter(PartWriter):
    suffix, packed = ".cram", False

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        if not options.get("header"):
            raise ValueError("writing CRAM needs a header")
        self.header = SamHeader.parse(options["header"])

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        index = {n: i for i, n in enumerate(self.header.names)}
        if self.with_header:
            yield file_start(self.header)
        held: list[pa.RecordBatch] = []
        count = 0

        def container(table: pa.Table) -> bytes:
            columns = table.to_pydict()
            missing = {x for c in ("contig", "mate_contig") for x in set(columns[c]) if x and x not in index}
            if missing:
                raise ValueError(f"contigs are not in the header: {sorted(missing)}")
            return encode_container(columns, index, count)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= CONTAINER_READS:
                table = pa.Table.from_batches(held)
                yield container(table.slice(0, CONTAINER_READS))
                count += CONTAINER_READS
                held = table.slice(CONTAINER_READS).to_batches()
        if sum(b.num_rows for b in held):
            yield container(pa.Table.from_batches(held))
        if self.with_header:
            yield END


__all__ = ["Container", "CramSource", "container_splits", "containers", "read_cram_header", "splits"]
