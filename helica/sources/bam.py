"""The ``bam`` data source: splittable scan and writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from helica.functions.intervals import Interval, merge_intervals, parse_intervals
from helica.functions.names import parse_boolean
from helica.sources import bgzf
from helica.sources.bam_codec import decode_records, encode_batch, header_bytes, plausible, read_bam_header
from helica.sources.bam_index import LinearIndex, SplittingIndex, SplittingIndexBuilder
from helica.sources.files import SPLIT_BYTES, create, exists, expand, size_of
from helica.sources.parts import PartFile, PartFolder
from helica.sources.records import Kind, VirtualRange, record_slices, resolve
from helica.sources.sam import READ_COLUMNS, READ_SCHEMA, SamHeader

def bam_kind(header: SamHeader) -> Kind:
    n = len(header.contigs)
    return Kind(36, lambda data, at: 4 + struct.unpack_from("<i", data, at)[0], lambda data, at: plausible(data, at, n))


class BamSource(DataSource):
    """Options: ``path``; ``intervals`` (``chr1:1-9,...``), ``unplaced`` (true: also reads without position),
    ``columns`` (only these are decoded), ``splitSize`` in bytes, ``useBai`` (false: do not skip by a ``.bai``
    beside the file), ``baiSplits`` (true: cut at the offsets of its linear index). Writing: ``header`` (SAM text) or ``headerFrom`` (a BAM file), ``writeHeader``,
    ``splittingIndex`` and ``granularity``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READ_SCHEMA + ", key long"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options, overwrite)


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        if parse_boolean(options.get("keepPairedReadsTogether"), False):
            raise ValueError("reads of a pair are no longer kept together")
        self.path = options["path"]
        self.split = int(options.get("splitSize", SPLIT_BYTES))
        self.intervals = parse_intervals(options.get("intervals"))
        self.unplaced = parse_boolean(options.get("unplaced"), False)
        self.use_bai = parse_boolean(options.get("useBai"), True)
        self.bounds: Interval | None = None
        self.bai_splits = parse_boolean(options.get("baiSplits"), False)
        wanted = options.get("columns")
        self.columns = {c.strip() for c in wanted.split(",")} if wanted else None
        if self.columns is not None and (self.intervals is not None or self.unplaced):
            self.columns |= {"contig", "start", "end"}
        unknown = (self.columns or set()) - {*READ_COLUMNS, "key"}
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of contig, start and end prune ranges and rows; Spark applies all filters again."""
        contig, low, high = None, 1, 2**31 - 1
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and column == "contig":
                contig = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == "start":
                high = min(high, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column in ("end", "start"):
                low = max(low, f.value)
            yield f
        if contig is not None and self.intervals is None and not self.unplaced:
            self.bounds = Interval(contig, low, high)
            if self.columns is not None:
                self.columns |= {"contig", "start", "end"}

    def partitions(self) -> list[VirtualRange]:
        parts: list[VirtualRange] = []
        for path in expand(self.path):
            size = size_of(path)
            if size:
                parts += self._ranges(path, size)
        return parts

    def _ranges(self, path: str, size: int) -> list[VirtualRange]:
        """By splitting index, else with ``baiSplits`` by the linear index, else by size; ranges that hold no selected read are left out."""
        side = path + ".splitting-bai"
        bai = next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if exists(p)), None)
        cuts = None
        if exists(side):
            cuts = SplittingIndex.read(side).cuts(self.split, size)
        elif self.bai_splits and bai:
            cuts = LinearIndex.read(bai).cuts(self.split, size, read_bam_header(path)[1])
        if cuts is None:
            ranges = [VirtualRange(path, a << 16, min(a + self.split, size) << 16, size, False) for a in range(0, size, self.split)]
        else:
            ranges = [VirtualRange(path, a, b, size, True) for a, b in zip(cuts, cuts[1:]) if a < b]
        wanted = self.intervals if self.bounds is None else [self.bounds]
        if wanted is None or not bai or not self.use_bai:
            return ranges
        header, _ = read_bam_header(path)
        missing = {i.contig for i in wanted} - set(header.names)
        if missing and self.bounds is None:
            raise ValueError(f"contigs are not in the header: {sorted(missing)}")
        chunks = LinearIndex.read(bai).chunks([(header.names.index(i.contig), i.start, i.stop) for i in merge_intervals(wanted) if i.contig not in missing], self.unplaced)
        return [r for r in ranges if any(a < (r.end + (1 << 32)) and b > r.start - (1 << 32) for a, b in chunks)] if chunks is not None else ranges

    def read(self, part: VirtualRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        header, begin = read_bam_header(part.path)
        if self.intervals is not None:
            missing = {i.contig for i in self.intervals} - set(header.names)
            if missing:
                raise ValueError(f"contigs are not in the header: {sorted(missing)}")
        kind = bam_kind(header)
        for data, offsets, _ in record_slices(part.path, *resolve(part, kind, begin), kind):
            yield self._selected(decode_records(data, offsets, header, self.columns))

    def _selected(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows that the options select, so that no more reach the JVM."""
        wanted = self.intervals if self.bounds is None else [self.bounds]
        if wanted is None and not self.unplaced:
            return batch
        ref = batch["ref_index"].to_numpy(zero_copy_only=False)
        keep = (ref < 0) if self.unplaced else np.zeros(len(ref), bool)
        if wanted:
            contig, start, end = (batch[c].to_numpy(zero_copy_only=False) for c in ("contig", "start", "end"))
            for i in merge_intervals(wanted):
                keep |= (contig == i.contig) & (start <= i.stop) & (end >= i.start)
        return batch.filter(pa.array(keep))


class BamWriter(PartFolder):
    """One file a partition, in block gzip without a terminator."""

    suffix = ".bam"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.header = read_bam_header(options["headerfrom"])[0] if options.get("headerfrom") else SamHeader.parse(options.get("header", ""))
        if not self.header.contigs and not options.get("header") and not options.get("headerfrom"):
            raise ValueError("writing BAM needs a header")
        self.index = parse_boolean(options.get("splittingindex"), False)
        self.granularity = int(options.get("granularity", 4096))

    def write(self, batches: Iterator[pa.RecordBatch]) -> PartFile:
        part = self.new_part(*([".splitting-bai"] if self.index else []))
        index = {n: i for i, n in enumerate(self.header.names)}
        builder = SplittingIndexBuilder(self.granularity)
        buffer, address = bytearray(), 0
        with create(part.path) as out:
            if self.with_header:
                block = bgzf.compress(header_bytes(self.header))
                out.write(block)
                address = len(block)
            for batch in batches:
                data, starts = encode_batch(batch, index)
                for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(data)]):
                    if buffer and len(buffer) + b - a > bgzf.PAYLOAD:
                        address += out.write(bgzf.compress(bytes(buffer)))
                        buffer.clear()
                    builder.add(address << 16 | len(buffer))
                    buffer += data[a:b]
                    while len(buffer) > bgzf.PAYLOAD:  # a record larger than a block
                        address += out.write(bgzf.deflate(bytes(buffer[: bgzf.PAYLOAD])))
                        del buffer[: bgzf.PAYLOAD]
            if buffer:
                address += out.write(bgzf.compress(bytes(buffer)))
        if self.index:
            with create(part.path + ".splitting-bai") as side:
                side.write(builder.finish(address))
        return part
