"""Indexes of record and block offsets: ``.splitting-bai``, ``.bgzfi``, ``.bai`` and ``.tbi``."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right

from helica.sources import bgzf
from helica.sources.files import open_file, size_of

DEFAULT_GRANULARITY = 4096
#: Shift of the windows of a linear index, a fixed value of the format.
WINDOW_SHIFT = 14


def _whole(path: str) -> bytes:
    with open_file(path) as f:
        return f.read()


class SplittingIndexBuilder:
    """Collects virtual offsets of records: the first, then every one whose number from 1 is a multiple of the granularity."""

    def __init__(self, granularity: int = DEFAULT_GRANULARITY):
        if granularity < 1:
            raise ValueError("granularity must be positive")
        self.granularity, self.count, self.offsets = granularity, 0, []

    def add(self, offset: int) -> None:
        self.count += 1
        if self.count == 1 or self.count % self.granularity == 0:
            self.offsets.append(offset)

    def finish(self, file_size: int) -> bytes:
        """The index file: big-endian offsets, the last one at the end of the file."""
        return struct.pack(f">{len(self.offsets) + 1}Q", *self.offsets, file_size << 16)


class SplittingIndex:
    """Sorted virtual offsets of records; the last is the end of the file."""

    def __init__(self, offsets: list[int]):
        if not offsets or any(a > b for a, b in zip(offsets, offsets[1:])):
            raise ValueError("a splitting index has to be sorted and not empty")
        self.offsets = offsets

    @classmethod
    def read(cls, path: str) -> SplittingIndex:
        data = _whole(path)
        if len(data) % 8:
            raise ValueError(f"{path} has no whole number of offsets")
        return cls(list(struct.unpack(f">{len(data) // 8}Q", data)))

    @property
    def file_size(self) -> int:
        return self.offsets[-1] >> 16

    def previous(self, position: int) -> int | None:
        """The last offset at or before a byte position."""
        i = bisect_right(self.offsets, position << 16)
        return self.offsets[i - 1] if i else None

    def next(self, position: int) -> int | None:
        """The first offset behind a byte position."""
        i = bisect_right(self.offsets, position << 16)
        return self.offsets[i] if i < len(self.offsets) else None

    def cuts(self, split: int, size: int) -> list[int]:
        """Record offsets that cut the file into ranges of about ``split`` bytes."""
        inner = [self.next(a) for a in range(split, size, split)]
        return sorted({self.offsets[0], *(c for c in inner if c is not None), size << 16})


def shift_index(data: bytes, by: int) -> list[int]:
    """The offsets of an index file after ``by`` bytes were put in front of its data, without the closing one."""
    offsets = struct.unpack(f">{len(data) // 8}Q", data)
    return [o + (by << 16) for o in offsets[:-1]]


def build_splitting_index(path: str, granularity: int = DEFAULT_GRANULARITY) -> bytes:
    """The splitting index of a BAM file, reading it once in pieces."""
    from helica.sources.bam import bam_kind
    from helica.sources.bam_codec import read_bam_header
    from helica.sources.records import record_slices

    header, begin = read_bam_header(path)
    builder, size = SplittingIndexBuilder(granularity), size_of(path)
    for _, _, offsets in record_slices(path, begin, size << 16, bam_kind(header)):
        for o in offsets.tolist():
            builder.add(o)
    return builder.finish(size)


class BlockIndex:
    """Addresses of every n-th block, and the length of the file; 0 belongs to it without being stored."""

    def __init__(self, offsets: list[int]):
        self.offsets = sorted({0, *offsets})

    @classmethod
    def read(cls, path: str) -> BlockIndex:
        data = _whole(path)
        if len(data) % 6:
            raise ValueError(f"{path} has no whole number of offsets")
        return cls([int.from_bytes(data[i : i + 6], "big") for i in range(0, len(data), 6)])

    def previous(self, position: int) -> int | None:
        i = bisect_right(self.offsets, position)
        return self.offsets[i - 1] if i else None

    def next(self, position: int) -> int | None:
        i = bisect_right(self.offsets, position)
        return self.offsets[i] if i < len(self.offsets) else None


def build_block_index(path: str, granularity: int) -> bytes:
    """The ``.bgzfi`` of a file: every ``granularity``-th block address as 48 bits, then the length."""
    if granularity < 1:
        raise ValueError("granularity must be positive")
    addresses = [a for i, (a, _, _) in enumerate(bgzf.block_addresses(path), 1) if i % granularity == 0]
    return b"".join(a.to_bytes(6, "big") for a in [*addresses, size_of(path)])


def bins_of(begin: int, end: int) -> set[int]:
    """All bins of the index scheme that may hold records on ``[begin, end)``."""
    last = max(end - 1, begin)
    return {0, *(first + b for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for b in range(begin >> shift, (last >> shift) + 1))}


class LinearIndex:
    """A ``.bai`` or (uncompressed) ``.tbi``: chunks by bin and offsets by window, for each reference."""

    def __init__(self, refs: list[tuple[dict[int, list[tuple[int, int]]], list[int]]], names: list[str] | None = None):
        self.refs, self.names = refs, names

    @classmethod
    def read(cls, path: str) -> LinearIndex:
        data = _whole(path)
        if data[:2] == b"\x1f\x8b":
            data = bgzf.decompress(data)
        names = None
        if data[:4] == b"BAI\1":
            n_ref, at = struct.unpack_from("<i", data, 4)[0], 8
        elif data[:4] == b"TBI\1":
            n_ref, n_names = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
            names = data[36 : 36 + n_names].decode().split("\0")[:-1]
            at = 36 + n_names
        else:
            raise ValueError(f"{path} is no index")
        refs = []
        for _ in range(n_ref):
            bins, n_bins = {}, struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(n_bins):
                number, n = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                bins[number] = list(zip(flat[::2], flat[1::2]))
                at += 8 + 16 * n
            n = struct.unpack_from("<i", data, at)[0]
            refs.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
            at += 4 + 8 * n
        return cls(refs, names)

    def chunks(self, spans: list[tuple[int, int, int]], unplaced: bool = False) -> list[tuple[int, int]]:
        """Virtual ranges that hold all records on the spans (reference, start, stop), merged; with ``unplaced`` also all behind the last placed record."""
        found: list[tuple[int, int]] = []
        for ref, start, stop in spans:
            if not 0 <= ref < len(self.refs):
                continue
            bins, linear = self.refs[ref]
            window = (start - 1) >> WINDOW_SHIFT
            low = linear[min(window, len(linear) - 1)] if linear else 0
            found += [(max(a, low), b) for n in bins_of(start - 1, stop) for a, b in bins.get(n, ()) if b > low]
        if unplaced:
            found.append((max((b for bins, _ in self.refs for n, c in bins.items() if n < 37450 for _, b in c), default=0), 1 << 63))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def cuts(self, split: int, size: int, begin: int) -> list[int]:
        """Record offsets from the linear parts that cut the file into ranges of about ``split`` bytes."""
        starts = sorted({o for _, linear in self.refs for o in linear if o > begin})
        inner = []
        for a in range(split, size, split):
            i = bisect_left(starts, a << 16)
            if i < len(starts):
                inner.append(starts[i])
        return sorted({begin, *inner, size << 16})


class _IndexBuilder:
    """Bins and windows of records that come in the order of reference and start."""

    def __init__(self) -> None:
        self.refs: dict[int, tuple[dict[int, list[list[int]]], dict[int, int]]] = {}
        self.before: tuple[int, int] | None = None

    def add(self, ref: int, begin: int, end: int, offset: int, after: int) -> None:
        """A record on ``[begin, end)`` whose bytes lie between two virtual offsets."""
        if self.before and (ref, begin) < self.before:
            raise ValueError("records are not sorted by coordinate")
        self.before = (ref, begin)
        bins, windows = self.refs.setdefault(ref, ({}, {}))
        chunks = bins.setdefault(smallest_bin(begin, end), [])
        if chunks and chunks[-1][1] == offset:
            chunks[-1][1] = after
        else:
            chunks.append([offset, after])
        for w in range(begin >> WINDOW_SHIFT, (max(end - 1, begin) >> WINDOW_SHIFT) + 1):
            windows.setdefault(w, offset)

    def body(self, n_refs: int) -> bytes:
        out = []
        for ref in range(n_refs):
            bins, windows = self.refs.get(ref, ({}, {}))
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            n, last, filled = max(windows, default=-1) + 1, 0, []
            for w in range(n):
                last = windows.get(w, last)
                filled.append(last)
            out.append(struct.pack(f"<i{n}Q", n, *filled))
        return b"".join(out)


def smallest_bin(begin: int, end: int) -> int:
    """The smallest bin of the index scheme that holds ``[begin, end)``."""
    last = max(end - 1, begin)
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == last >> shift:
            return first + (begin >> shift)
    return 0


def build_tabix(path: str) -> bytes:
    """The ``.tbi`` of a block gzip VCF file that is sorted by contig and position."""
    size, builder, names = size_of(path), _IndexBuilder(), {}
    held: tuple[int, int, int, int] | None = None
    for offset, line in bgzf.bgzf_lines(path, 0, size, size):
        if held:
            builder.add(*held, offset)
            held = None
        if not line or line.startswith(b"#"):
            continue
        f = line.split(b"\t", 8)
        ends = [int(e[4:]) for e in f[7].split(b";") if e.startswith(b"END=") and e[4:].isdigit()]
        begin = int(f[1]) - 1
        held = (names.setdefault(f[0].decode(), len(names)), begin, ends[0] if ends else begin + len(f[3]), offset)
    if held:
        builder.add(*held, size << 16)
    block = "".join(n + "\0" for n in names).encode()
    # Preset of VCF, columns of contig and position, comment sign, lines to skip.
    head = b"TBI\1" + struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, len(block)) + block
    return bgzf.compress(head + builder.body(len(names)), end=True)


def build_bai(path: str) -> bytes:
    """The ``.bai`` of a BAM file that is sorted by coordinate."""
    from helica.sources.bam import bam_kind
    from helica.sources.bam_codec import decode_records, read_bam_header
    from helica.sources.records import record_slices

    header, begin = read_bam_header(path)
    size, builder, unplaced = size_of(path), _IndexBuilder(), 0
    held: tuple[int, int, int, int] | None = None
    for data, offsets, virtual in record_slices(path, begin, size << 16, bam_kind(header)):
        batch = decode_records(data, offsets, header, {"end"})
        for ref, start, end, v in zip(batch["ref_index"].to_pylist(), batch["start"].to_pylist(), batch["end"].to_pylist(), virtual.tolist()):
            if held:
                builder.add(*held, v)
                held = None
            if ref < 0 or start < 1:
                unplaced += 1
            else:
                held = (ref, start - 1, max(end, start), v)
    if held:
        builder.add(*held, size << 16)
    return b"BAI\1" + struct.pack("<i", len(header.contigs)) + builder.body(len(header.contigs)) + struct.pack("<Q", unplaced)
