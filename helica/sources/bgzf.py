"""Block gzip: gzip members of at most 64 KiB whose size stands in their header."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

from helica.sources.files import open_file

MAGIC = b"\x1f\x8b\x08\x04"
#: Largest block, and the uncompressed bytes put into one when writing.
MAX_BLOCK, PAYLOAD = 1 << 16, 0xFF00
#: The empty block at the end of a complete file; a fixed value of the format.
TERMINATOR = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(data: bytes, at: int = 0) -> int | None:
    """Size of the block whose header stands at ``at``; None if there is no such header."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    field, end = at + 12, at + 12 + extra
    while field + 4 <= end and field + 6 <= len(data):
        kind, n = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + n
    return None


def inflate(block: bytes) -> bytes:
    """The data of one whole block; its checksum and length are verified."""
    extra = struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[12 + extra : -8], -15)
    check, length = struct.unpack("<II", block[-8:])
    if length != len(data) or check != zlib.crc32(data):
        raise ValueError("damaged block")
    return data


def deflate(data: bytes, level: int = 5) -> bytes:
    """One block of at most ``PAYLOAD`` bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(body) + 26
    if size > MAX_BLOCK:
        squeeze = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = squeeze.compress(data) + squeeze.flush()
        size = len(body) + 26
    return MAGIC + struct.pack("<IBBH2sHH", 0, 0, 0xFF, 6, b"BC", 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, level: int = 5, end: bool = False) -> bytes:
    """Blocks with ``data``; with ``end`` also the terminator."""
    blocks = [deflate(data[i : i + PAYLOAD], level) for i in range(0, len(data), PAYLOAD)]
    return b"".join(blocks) + (TERMINATOR if end else b"")


def decompress(data: bytes) -> bytes:
    return b"".join(d for _, _, d in walk_bytes(data))


def walk_bytes(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(address, size, data) of the blocks in ``data``."""
    while at < len(data):
        n = block_size(data, at)
        if n is None or at + n > len(data):
            raise ValueError(f"no block at {at}")
        yield at, n, inflate(data[at : at + n])
        at += n


def find_block(path: str, start: int, size: int) -> int:
    """Address of the first block at or after ``start``; ``size`` if there is none.

    A block is real if it inflates with the right checksum, so chance bytes inside
    compressed data are never taken for one.
    """
    if start <= 0:
        return 0
    with open_file(path) as f:
        while start < size:
            f.seek(start)
            data = f.read(4 * MAX_BLOCK)
            if not data:
                break
            step, at = max(1, len(data) - 17), data.find(MAGIC)
            while at >= 0:
                n = block_size(data, at)
                if n and start + at + n <= size:
                    if at + n > len(data):
                        step = at  # begins here but ends behind the window: look again from here
                        break
                    if _is_whole(data[at : at + n]):
                        return start + at
                at = data.find(MAGIC, at + 1)
            start += step
        return size


def _is_whole(block: bytes) -> bool:
    try:
        inflate(block)
        return True
    except (ValueError, zlib.error, struct.error):
        return False


class Blocks:
    """The blocks of a file from an address on, read ahead in large pieces."""

    def __init__(self, path: str, address: int = 0, piece: int = 1 << 20):
        self.file, self.piece = open_file(path), max(piece, 2 * MAX_BLOCK)
        self.file.seek(address)
        self.base, self.data, self.at = address, b"", 0

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        while True:
            if len(self.data) - self.at < MAX_BLOCK:
                more = self.file.read(self.piece)
                self.base += self.at
                self.data, self.at = self.data[self.at :] + more, 0
                if not self.data:
                    self.file.close()
                    return
            n = block_size(self.data, self.at)
            if n is None or self.at + n > len(self.data):
                raise ValueError(f"no block at {self.base + self.at}")
            yield self.base + self.at, n, inflate(self.data[self.at : self.at + n])
            self.at += n


def block_addresses(path: str) -> Iterator[tuple[int, int, int]]:
    """(address, size, uncompressed length) of all blocks, reading only their headers and ends."""
    with open_file(path) as f:
        at = 0
        while True:
            f.seek(at)
            head = f.read(64)
            if not head:
                return
            n = block_size(head)
            if n is None:
                raise ValueError(f"no block at {at}")
            f.seek(at + n - 4)
            yield at, n, struct.unpack("<I", f.read(4))[0]
            at += n


def sniff(path: str) -> str:
    """``bgzf``, ``gzip`` or ``plain``, from the first bytes."""
    with open_file(path) as f:
        head = f.read(64)
    return "bgzf" if block_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "plain"


def head_of(path: str, length: int = 1 << 16) -> bytes:
    """The first bytes of a file, uncompressed."""
    with open_file(path) as f:
        raw = gzip.GzipFile(fileobj=f) if sniff(path) != "plain" else f
        return raw.read(length)


def bgzf_lines(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that begin in blocks with an address in ``[start, end)``."""
    first = find_block(path, start, size)
    if first >= end:
        return
    skip, rest, rest_at = first > 0, b"", 0
    if skip:  # a line that starts with the block belongs to this range if the byte before it ends a line
        skip = not _ends_line(path, first)
    for address, _, data in Blocks(path, first):
        at = 0
        if address >= end and not rest:
            return
        while True:
            cut = data.find(b"\n", at)
            if cut < 0:
                break
            line, where = rest + data[at:cut], rest_at if rest else (address << 16) + at
            rest, at = b"", cut + 1
            if skip:
                skip = False
            elif where >> 16 >= end:
                return
            else:
                yield where, line.removesuffix(b"\r")
            if address >= end:
                return
        if at < len(data):
            if not rest:
                rest_at = (address << 16) + at
            rest += data[at:]
    if rest and not skip and rest_at >> 16 < end:
        yield rest_at, rest.removesuffix(b"\r")


def _ends_line(path: str, address: int) -> bool:
    """Whether the data before the block at ``address`` ends with a line feed."""
    back = max(0, address - 2 * MAX_BLOCK)
    previous = None
    at = find_block(path, back, address) if back else 0
    for a, n, data in Blocks(path, at):
        if a >= address:
            break
        if data:
            previous = data[-1:]
    return previous is None or previous == b"\n"
