"""Records with a length in front, packed into block gzip: where they start, and reading a range of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import InputPartition

from helica.sources import bgzf

BATCH_BYTES = 4 << 20
#: Records and blocks over which a guessed start has to hold.
PROBE_RECORDS, PROBE_BLOCKS = 64, 3


@dataclass
class VirtualRange(InputPartition):
    """Records from virtual offset ``start`` up to ``end``. Where ``exact`` is false both are only
    addresses in the file, and the task looks for the first record at or after each."""

    path: str
    start: int
    end: int
    size: int
    exact: bool


@dataclass(frozen=True)
class Kind:
    """How records of a format look: bytes needed for the length, the whole length, and a test of a start."""

    head: int
    length: Callable[[bytes, int], int]
    plausible: Callable[[bytes, int], bool]


def first_record(path: str, address: int, size: int, kind: Kind, begin: int) -> int:
    """Virtual offset of the first record in the first block at or after ``address``, ``size << 16`` if there is none.

    ``begin`` is the file's first record. A start counts if plausible records
    follow each other from it over several blocks. The reader also checks that its
    last record ends where the next range starts, so a wrong guess is an error and
    never a wrong result.
    """
    if address <= begin >> 16:
        return begin
    block = bgzf.find_block(path, address, size)
    while block < size:
        data, n_first, next_block, ends = b"", 0, size, True
        for i, (at, n, part) in enumerate(bgzf.Blocks(path, block, 8 * bgzf.MAX_BLOCK)):
            if i == 0:
                n_first, next_block = len(part), at + n
            data += part
            if i >= PROBE_BLOCKS and len(data) > 1 << 18:
                ends = False
                break
        for u in range(n_first):
            if kind.plausible(data, u) and _holds(data, u, kind, ends):
                return block << 16 | u
        block = next_block
    return size << 16


def _holds(data: bytes, at: int, kind: Kind, ends: bool) -> bool:
    for _ in range(PROBE_RECORDS):
        if at == len(data):
            return True
        if at + kind.head > len(data) or at > len(data):
            return not ends
        if not kind.plausible(data, at):
            return False
        at += kind.length(data, at)
    return at <= len(data) or not ends


def resolve(part: VirtualRange, kind: Kind, begin: int) -> tuple[int, int]:
    """The virtual offsets of the first record of a range and of the first behind it."""
    if part.exact:
        return max(part.start, begin), part.end
    end = part.size << 16 if part.end >> 16 >= part.size else first_record(part.path, part.end >> 16, part.size, kind, begin)
    return first_record(part.path, part.start >> 16, part.size, kind, begin), end


def record_slices(path: str, start: int, end: int, kind: Kind) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(data, offsets in it, virtual offsets) of the records that start in ``[start, end)``, in bounded pieces."""
    if start >= end:
        return
    data, marks, skip, finished = b"", [], start & 0xFFFF, False

    def limit() -> int | None:
        """Where ``end`` lies in ``data``, once its block has come."""
        for p, a in marks:
            if a == end >> 16:
                return p + (end & 0xFFFF)
            if a > end >> 16:
                return p
        return None

    def whole() -> tuple[np.ndarray, int]:
        nonlocal finished
        offsets, at, stop = [], 0, limit()
        while at + kind.head <= len(data) and (stop is None or at < stop):
            n = kind.length(data, at)
            if n < kind.head:
                raise ValueError(f"{path}: bad record length {n}")
            if at + n > len(data):
                break
            offsets.append(at)
            at += n
        if stop is not None and at >= stop:
            if at > stop:
                raise ValueError(f"{path}: a record runs over the start of the next range; give the file a splitting index")
            finished = True
        return np.array(offsets, np.int64), at

    def virtual(offsets: np.ndarray) -> np.ndarray:
        places, blocks = np.array([p for p, _ in marks]), np.array([a for _, a in marks])
        k = np.searchsorted(places, offsets, "right") - 1
        return (blocks[k] << 16) + (offsets - places[k])

    for address, _, part in bgzf.Blocks(path, start >> 16):
        marks.append((len(data) - skip, address))
        data += part[skip:]
        skip = 0
        if len(data) >= BATCH_BYTES or address >= end >> 16:
            offsets, at = whole()
            if len(offsets):
                yield data, offsets, virtual(offsets)
            if finished:
                return
            data = data[at:]
            marks = [(p - at, a) for p, a in marks]
            marks = marks[max((i for i, (p, _) in enumerate(marks) if p <= 0), default=0) :]
    offsets, at = whole()
    if len(offsets):
        yield data, offsets, virtual(offsets)
    if at != len(data) and not finished:
        raise ValueError(f"{path}: ends inside a record")
