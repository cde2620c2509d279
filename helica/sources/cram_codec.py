"""CRAM 3 between bytes and reads: blocks, encodings, and the records of slices."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache


from helica.sources.bam_codec import decode_tags, encode_tags, text_of
from helica.sources.files import open_file
from helica.sources.sam import SamHeader

#: Fixed values of the format: start of a file, kinds of blocks, and the container at the end of a complete file.
MAGIC = b"CRAM\3\0"
FILE_HEADER, COMPRESSION_HEADER, SLICE_HEADER, EXTERNAL, CORE = 0, 1, 2, 4, 5
END = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
#: Bits of the flags that a record has beside those of BAM: qualities as a whole, mate described here, mate further down, no bases.
QUALITIES, DETACHED, DOWNSTREAM, NO_BASES = 1, 2, 4, 8
BASES = "ACGTN"
UNMAPPED, MATE_UNMAPPED, REVERSED, MATE_REVERSED = 4, 8, 16, 32
MULTIPLE = -2
#: The score of bases without one in reads where others have one.
NO_QUALITY = 30


class Cursor:
    """Bytes that are read from the front."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("a block ends inside a value")
        return self.data[self.at - n : self.at]

    def until(self, stop: int) -> bytes:
        end = self.data.index(stop, self.at)
        found, self.at = self.data[self.at : end], end + 1
        return found

    def number(self) -> int:
        """A signed number of 1 to 5 bytes; the leading one-bits of the first tell how many follow."""
        data, at = self.data, self.at
        first = data[at]
        if first < 0x80:
            self.at += 1
            return first
        if first < 0xF0:
            extra = 1 if first < 0xC0 else 2 if first < 0xE0 else 3
            self.at += 1 + extra
            return (first & (0x7F >> extra)) << 8 * extra | int.from_bytes(data[at + 1 : at + 1 + extra], "big")
        self.at += 5
        value = (first & 15) << 28 | int.from_bytes(data[at + 1 : at + 4], "big") << 4 | data[at + 4] & 15
        return value - (1 << 32) if value >> 31 else value

    def long(self) -> int:
        """A number of 1 to 9 bytes."""
        first = self.byte()
        extra = 8 - (first ^ 0xFF).bit_length()
        high = first & (0x7F >> extra) if extra < 7 else 0
        value = high << 8 * extra | int.from_bytes(self.take(extra), "big")
        return value - (1 << 64) if value >> 63 else value

    def numbers(self) -> list[int]:
        return [self.number() for _ in range(self.number())]


def put_number(value: int) -> bytes:
    v = value & 0xFFFFFFFF
    if v < 0x80:
        return bytes((v,))
    for extra, limit, mark in ((1, 1 << 14, 0x80), (2, 1 << 21, 0xC0), (3, 1 << 28, 0xE0)):
        if v < limit:
            return bytes((mark | v >> 8 * extra,)) + (v & ((1 << 8 * extra) - 1)).to_bytes(extra, "big")
    return bytes((0xF0 | v >> 28, v >> 20 & 255, v >> 12 & 255, v >> 4 & 255, v & 15))


def put_long(value: int) -> bytes:
    for extra in range(8):
        if value < 1 << 7 * (extra + 1):
            return ((0xFF00 >> extra & 0xFF) << 8 * extra | value).to_bytes(extra + 1, "big")
    return b"\xff" + value.to_bytes(8, "big")


def put_numbers(values: list[int]) -> bytes:
    return put_number(len(values)) + b"".join(map(put_number, values))


# --- blocks ------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    kind: int
    number: int
    data: bytes


def read_block(at: Cursor) -> Block:
    begin = at.at
    method, kind, number, packed, size = at.byte(), at.byte(), at.number(), at.number(), at.number()
    body = at.take(packed)
    if zlib.crc32(at.data[begin : at.at]) != struct.unpack("<I", at.take(4))[0]:
        raise ValueError("damaged block")
    unpack = {0: bytes, 1: gzip.decompress, 2: bz2.decompress, 3: lzma.decompress, 4: rans_decode}.get(method)
    if unpack is None:
        raise ValueError(f"unknown compression of a block: {method}")
    data = unpack(body) if packed else b""
    if len(data) != size:
        raise ValueError("a block has another size than it says")
    return Block(kind, number, data)


def block_bytes(kind: int, number: int, data: bytes, packed: bool = True) -> bytes:
    squeezed = gzip.compress(data, 5, mtime=0) if packed and len(data) > 64 else data
    if len(squeezed) >= len(data):
        squeezed, packed = data, False
    head = bytes((int(packed and squeezed is not data), kind)) + put_number(number) + put_number(len(squeezed)) + put_number(len(data))
    body = head + squeezed
    return body + struct.pack("<I", zlib.crc32(body))


def _frequencies(at: Cursor, one: Callable[[int], None]) -> None:
    """Symbols with something after each; runs of neighbours are shortened."""
    symbol, run = at.byte(), 0
    while True:
        one(symbol)
        if run:
            run -= 1
            symbol += 1
        else:
            following = at.byte()
            if following == symbol + 1:
                run = at.byte()
            symbol = following
        if symbol == 0:
            return


def _slots(at: Cursor) -> tuple[list[int], list[int], list[int]]:
    """Symbol of each of 4096 slots, frequency and first slot of each symbol."""
    share, first, slots = [0] * 256, [0] * 256, []

    def one(symbol: int) -> None:
        n = at.byte()
        if n >= 128:
            n = (n & 127) << 8 | at.byte()
        n = n or 4096
        share[symbol], first[symbol] = n, len(slots)
        slots.extend([symbol] * n)

    _frequencies(at, one)
    slots.extend([0] * (4096 - len(slots)))
    return slots, share, first


def rans_decode(data: bytes) -> bytes:
    """A block in the entropy coding with four interleaved states, of order 0 or 1."""
    order, _, size = struct.unpack_from("<BII", data)
    at = Cursor(data, 9)
    tables: dict[int, tuple] = {}
    if order == 0:
        tables[0] = _slots(at)
    else:
        _frequencies(at, lambda context: tables.__setitem__(context, _slots(at)))
    states = list(struct.unpack_from("<4I", data, at.at))
    p, out = at.at + 16, bytearray(size)

    def step(k: int, context: int) -> int:
        nonlocal p
        slots, share, first = tables[context]
        x = states[k]
        m = x & 4095
        symbol = slots[m]
        x = share[symbol] * (x >> 12) + m - first[symbol]
        while x < 1 << 23 and p < len(data):
            x = x << 8 | data[p]
            p += 1
        states[k] = x
        return symbol

    if order == 0:
        for i in range(size):
            out[i] = step(i & 3, 0)
        return bytes(out)
    quarter, last = size >> 2, [0, 0, 0, 0]
    for i in range(quarter):
        for k in range(4):
            last[k] = out[k * quarter + i] = step(k, last[k])
    for i in range(4 * quarter, size):
        last[3] = out[i] = step(3, last[3])
    return bytes(out)


# --- encodings ---------------------------------------------------------------


class Bits:
    """The core block, bit by bit from the highest."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the core block ends inside a value")
        return self.value >> self.left & ((1 << n) - 1)

    def ones(self, stop: int) -> int:
        """The number of bits up to the first that is ``stop``."""
        n = 0
        while self.take(1) != stop:
            n += 1
        return n


@dataclass
class Streams:
    """What the encodings of a slice read from."""

    core: Bits
    external: dict[int, Cursor]

    def of(self, number: int) -> Cursor:
        return self.external.setdefault(number, Cursor(b""))


def _codes(alphabet: list[int], lengths: list[int]) -> dict[tuple[int, int], int]:
    """Canonical codes as (length, code)."""
    found, code, before = {}, 0, 0
    for n, symbol in sorted(zip(lengths, alphabet)):
        code <<= n - before
        found[n, code] = symbol
        code, before = code + 1, n
    return found


def integer(at: Cursor, as_byte: bool = False) -> Callable[[Streams], int]:
    """A decoder of numbers (or single bytes) from its description."""
    codec, own = at.number(), Cursor(at.take(at.number()))
    if codec == 1:
        n = own.number()
        return (lambda s: s.of(n).byte()) if as_byte else (lambda s: s.of(n).number())
    if codec == 3:
        alphabet, lengths = own.numbers(), own.numbers()
        if len(alphabet) == 1 and lengths == [0]:
            return lambda s, only=alphabet[0]: only
        codes = _codes(alphabet, lengths)

        def huffman(s: Streams) -> int:
            code = n = 0
            while (n, code) not in codes:
                if n > 31:
                    raise ValueError("no such code")
                code, n = code << 1 | s.core.take(1), n + 1
            return codes[n, code]

        return huffman
    if codec == 6:
        shift, n = own.number(), own.number()
        return lambda s: s.core.take(n) - shift
    if codec == 7:
        shift, k = own.number(), own.number()

        def subexponential(s: Streams) -> int:
            u = s.core.ones(0)
            return (s.core.take(k) if u == 0 else 1 << (u + k - 1) | s.core.take(u + k - 1)) - shift

        return subexponential
    if codec == 8 or codec == 2:
        shift, k = own.number(), own.number()
        width = k if codec == 8 else (k - 1).bit_length()

        def golomb(s: Streams) -> int:
            whole = s.core.ones(0)
            if codec == 8 or k & (k - 1) == 0:
                return (whole << width | s.core.take(width)) - shift
            short = (1 << width) - k
            rest = s.core.take(width - 1)
            if rest >= short:
                rest = (rest << 1 | s.core.take(1)) - short
            return whole * k + rest - shift

        return golomb
    if codec == 9:
        shift = own.number()

        def gamma(s: Streams) -> int:
            n = s.core.ones(1)
            return (1 << n | s.core.take(n)) - shift

        return gamma
    if codec == 0:
        return lambda s: 0
    raise ValueError(f"unknown encoding of numbers: {codec}")


def byte_array(at: Cursor) -> Callable[[Streams], bytes]:
    """A decoder of byte arrays that know their own length."""
    codec, own = at.number(), Cursor(at.take(at.number()))
    if codec == 4:
        length, some = integer(own), many_bytes(own)
        return lambda s: some(s, length(s))
    if codec == 5:
        stop, n = own.byte(), own.number()
        return lambda s: s.of(n).until(stop)
    if codec == 0:
        return lambda s: b""
    raise ValueError(f"unknown encoding of bytes: {codec}")


def many_bytes(at: Cursor) -> Callable[[Streams, int], bytes]:
    """A decoder of as many bytes as are asked for."""
    begin = at.at
    codec, own = at.number(), Cursor(at.take(at.number()))
    if codec == 1:
        n = own.number()
        return lambda s, k: s.of(n).take(k)
    one = integer(Cursor(at.data, begin), True)
    return lambda s, k: bytes(one(s) & 255 for _ in range(k))


NUMBERS = ("BF", "CF", "RI", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "NF", "TL", "FN", "FP", "DL", "RS", "PD", "HC", "MQ")
SINGLE = ("FC", "BS")
ARRAYS = ("RN", "IN", "SC", "BB", "QQ")
SEVERAL = ("BA", "QS")


@dataclass
class Compression:
    """What the compression header of a container says."""

    names: bool = True
    deltas: bool = True
    needs_reference: bool = True
    substitutions: list[str] = field(default_factory=list)
    tag_lines: list[list[tuple[bytes, int]]] = field(default_factory=list)
    series: dict[str, Callable] = field(default_factory=dict)
    tags: dict[int, Callable] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: bytes) -> Compression:
        at, found = Cursor(data), cls()
        at.number()
        for _ in range(at.number()):
            key = at.take(2)
            if key == b"SM":
                raw = at.take(5)
                for base, codes in zip(BASES, raw):
                    others = [b for b in BASES if b != base]
                    found.substitutions.append("".join(b for _, b in sorted((codes >> 6 - 2 * i & 3, b) for i, b in enumerate(others))))
            elif key == b"TD":
                lines = at.take(at.number()).split(b"\0")
                found.tag_lines = [[(x[i : i + 3], x[i] << 16 | x[i + 1] << 8 | x[i + 2]) for i in range(0, len(x), 3)] for x in lines[:-1]]
            else:
                setattr(found, {b"RN": "names", b"AP": "deltas", b"RR": "needs_reference"}[key], bool(at.byte()))
        at.number()
        for _ in range(at.number()):
            key = at.take(2).decode()
            begin = at.at
            at.number()
            at.take(at.number())
            own = Cursor(data, begin)
            if key in NUMBERS:
                found.series[key] = integer(own)
            elif key in SINGLE:
                found.series[key] = integer(own, True)
            elif key in ARRAYS:
                found.series[key] = byte_array(own)
            elif key in SEVERAL:
                found.series[key] = many_bytes(own)
        at.number()
        for _ in range(at.number()):
            key = at.number()
            found.tags[key] = byte_array(at)
        return found


# --- records -----------------------------------------------------------------


class Reference:
    """Sequences of a FASTA file, one at a time in memory."""

    def __init__(self, path: str):
        self.path = path

    @lru_cache(maxsize=2)
    def sequence(self, name: str) -> str:
        parts, inside = [], False
        with open_file(self.path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    if line.startswith(b">"):
                        if inside:
                            return "".join(parts)
                        inside = line[1:].split()[:1] == [name.encode()]
                    elif inside:
                        parts.append(line.strip().decode().upper())
            if inside:
                parts.append(rest.strip().decode().upper())
        if not parts:
            raise ValueError(f"{self.path} has no sequence {name}")
        return "".join(parts)


@dataclass
class Slice:
    ref: int
    start: int
    n_records: int
    counter: int
    streams: Streams


def slices_of(container: bytes) -> Iterator[tuple[Compression, Slice]]:
    """The slices of the data of a container."""
    at = Cursor(container)
    first = read_block(at)
    if first.kind != COMPRESSION_HEADER:
        return
    compression = Compression.parse(first.data)
    while at.at < len(container):
        head = Cursor(read_block(at).data)
        ref, start, _, n, counter, blocks = head.number(), head.number(), head.number(), head.number(), head.long(), head.number()
        core, external = b"", {}
        for _ in range(blocks):
            block = read_block(at)
            if block.kind == CORE:
                core = block.data
            else:
                external[block.number] = Cursor(block.data)
        yield compression, Slice(ref, start, n, counter, Streams(Bits(core), external))


def decode_container(container: bytes, header: SamHeader, reference: Reference | None = None) -> Iterator[dict]:
    """The reads of a container, with the columns of reads."""
    groups = [next((f[3:] for f in line.split("\t") if f.startswith("ID:")), "") for line in header.text.splitlines() if line.startswith("@RG")]
    for compression, part in slices_of(container):
        before = [part.start]
        rows = [_record(compression, part, header, groups, reference, i, before) for i in range(part.n_records)]
        _link_mates(rows)
        names = header.names
        for r in rows:
            r["contig"] = names[r["ref_index"]] if r["ref_index"] >= 0 else None
            r["mate_contig"] = names[r["mate_ref_index"]] if r["mate_ref_index"] >= 0 else None
            r.pop("_next", None)
            yield r


def _record(c: Compression, part: Slice, header: SamHeader, groups: list[str], reference: Reference | None, i: int, before: list[int]) -> dict:
    s, get = part.streams, c.series
    flags, own = get["BF"](s), get["CF"](s)
    ref = get["RI"](s) if part.ref == MULTIPLE else part.ref
    n = get["RL"](s)
    start = get["AP"](s)
    if c.deltas:
        before[0] = start = before[0] + start
    group = get["RG"](s)
    name = text_of(get["RN"](s)) if c.names else None
    row = {"flags": flags, "ref_index": ref, "start": start, "mate_ref_index": -1, "mate_start": 0, "insert_size": 0}
    if own & DETACHED:
        mate = get["MF"](s)
        row["flags"] |= (MATE_REVERSED if mate & 1 else 0) | (MATE_UNMAPPED if mate & 2 else 0)
        if not c.names:
            name = text_of(get["RN"](s))
        row["mate_ref_index"], row["mate_start"], row["insert_size"] = get["NS"](s), get["NP"](s), get["TS"](s)
    elif own & DOWNSTREAM:
        row["_next"] = i + get["NF"](s) + 1
    row["read_name"] = name if name is not None else ""
    raw = b"".join(tag + c.tags[key](s) for tag, key in c.tag_lines[get["TL"](s)]) if c.tag_lines else b""
    tags = decode_tags(raw)
    if group >= 0 and group < len(groups):
        tags = f"{tags}\tRG:Z:{groups[group]}" if tags else f"RG:Z:{groups[group]}"
    row["tags"] = tags
    quals: bytearray | None = None
    if flags & UNMAPPED:
        bases = "*" if own & NO_BASES or not n else get["BA"](s, n).decode("latin-1")
        row["cigar"], row["mapq"], span = "*", 0, 0
    else:
        bases, row["cigar"], span, quals = _features(c, s, n, ref, start, own, header, reference)
        row["mapq"] = get["MQ"](s)
    if own & QUALITIES and n:
        row["quals"] = bytes(q + 33 for q in get["QS"](s, n)).decode("latin-1")
    else:
        row["quals"] = bytes(q + 33 for q in quals).decode("latin-1") if quals else "*"
    row["bases"] = bases
    row["end"] = start + max(span - 1, 0)
    return row


def _features(c: Compression, s: Streams, n: int, ref: int, start: int, own: int, header: SamHeader, reference: Reference | None) -> tuple[str, str, int, bytearray | None]:
    """Bases, CIGAR, positions covered and single qualities of a mapped read, from what it has beside the reference."""
    get, bases, quals = c.series, bytearray(b"?" * n), None
    steps: list[list] = []
    done, place, at_ref, missing = 0, 0, start - 1, []

    def step(length: int, op: str) -> None:
        if length and steps and steps[-1][1] == op:
            steps[-1][0] += length
        elif length:
            steps.append([length, op])

    def like_reference(to: int) -> None:
        nonlocal done, at_ref
        if to > done:
            missing.append((done, to, at_ref))
            step(to - done, "M")
            at_ref += to - done
            done = to

    def single(q: int, at: int) -> None:
        nonlocal quals
        if quals is None:
            quals = bytearray([NO_QUALITY]) * n
        quals[at] = q

    def put(some: bytes, op: str) -> None:
        nonlocal done, at_ref
        bases[done : done + len(some)] = some
        step(len(some), op)
        done += len(some)
        at_ref += len(some) if op == "M" else 0

    for _ in range(get["FN"](s)):
        code = chr(get["FC"](s))
        place += get["FP"](s)
        if code not in "qQ":
            like_reference(place - 1)
        if code == "b":
            put(get["BB"](s), "M")
        elif code == "B":
            put(get["BA"](s, 1), "M")
            single(get["QS"](s, 1)[0], done - 1)
        elif code == "X":
            base = (reference.sequence(header.names[ref])[at_ref : at_ref + 1] or "N") if reference else None
            if base is None:
                raise ValueError("this CRAM file needs the path of its reference")
            known = BASES.index(base) if base in BASES else 4
            put(c.substitutions[known][get["BS"](s)].encode(), "M")
        elif code == "I":
            put(get["IN"](s), "I")
        elif code == "i":
            put(get["BA"](s, 1), "I")
        elif code == "S":
            put(get["SC"](s), "S")
        elif code == "D" or code == "N":
            length = get["DL" if code == "D" else "RS"](s)
            step(length, code)
            at_ref += length
        elif code == "P" or code == "H":
            step(get["PD" if code == "P" else "HC"](s), code)
        elif code == "q":
            for k, q in enumerate(get["QQ"](s)):
                single(q, place - 1 + k)
        elif code == "Q":
            single(get["QS"](s, 1)[0], place - 1)
        else:
            raise ValueError(f"unknown feature {code!r}")
    like_reference(n)
    text = "*"
    if not own & NO_BASES and n:
        for a, b, r in missing:
            if reference is None:
                raise ValueError("this CRAM file needs the path of its reference")
            bases[a:b] = reference.sequence(header.names[ref])[r : r + b - a].ljust(b - a, "N").encode()
        text = bases.decode("latin-1")
    covered = sum(k for k, op in steps if op in "MDN")
    return text, "".join(f"{k}{op}" for k, op in steps) or "*", covered, quals


def _link_mates(rows: list[dict]) -> None:
    """Mates that stand further down in the slice: each read points to the next of its template, the last to the first."""
    for i, r in enumerate(rows):
        if "_next" not in r or r.get("_linked"):
            continue
        chain = [i]
        while "_next" in rows[chain[-1]]:
            chain.append(rows[chain[-1]]["_next"])
        for here, there in zip(chain, [*chain[1:], chain[0]]):
            a, b = rows[here], rows[there]
            a["mate_ref_index"], a["mate_start"], a["_linked"] = b["ref_index"], b["start"], True
            a["read_name"] = a["read_name"] or rows[chain[0]]["read_name"]
            a["flags"] |= (MATE_REVERSED if b["flags"] & REVERSED else 0) | (MATE_UNMAPPED if b["flags"] & UNMAPPED else 0)
        both = [rows[k] for k in chain]
        if len({r["ref_index"] for r in both}) == 1 and not any(r["flags"] & UNMAPPED for r in both):
            low, high = min(r["start"] for r in both), max(r["end"] for r in both)
            first = next(r for r in both if r["start"] == low)
            for r in both:
                r["insert_size"] = (high - low + 1) * (1 if r is first else -1)
    for r in rows:
        r.pop("_linked", None)


# --- writing -----------------------------------------------------------------


def file_start(header: SamHeader) -> bytes:
    """The definition of a file and the container with its header."""
    text = header.text.encode()
    block = block_bytes(FILE_HEADER, 0, struct.pack("<i", len(text)) + text)
    return MAGIC + bytes(20) + container_bytes(block, 0, 0, 0, 0, 0, 0, 1, [0])


def container_bytes(data: bytes, ref: int, start: int, span: int, records: int, counter: int, bases: int, blocks: int, marks: list[int]) -> bytes:
    head = struct.pack("<i", len(data)) + b"".join(map(put_number, (ref, start, span, records))) + put_long(counter) + put_long(bases) + put_number(blocks) + put_numbers(marks)
    return head + struct.pack("<I", zlib.crc32(head)) + data


class _Series:
    """Bytes of each data series of a container."""

    def __init__(self) -> None:
        self.data: dict[str, bytearray] = {}

    def number(self, key: str, value: int) -> None:
        self.data.setdefault(key, bytearray()).extend(put_number(value))

    def put(self, key: str, some: bytes) -> None:
        self.data.setdefault(key, bytearray()).extend(some)

    def sized(self, key: str, some: bytes) -> None:
        self.number(key + "#", len(some))
        self.put(key, some)


def encode_container(rows: dict[str, list], index: dict[str, int], counter: int) -> bytes:
    """Reads as one container with one slice.

    Every series has a block of its own; bases are stored beside the reference, so
    none is needed to read them. The operations ``=`` and ``X`` come back as ``M``;
    CIGAR and mapping quality of unmapped reads, and a missing CIGAR of mapped ones,
    have no place in the format.
    """
    import re

    s, lines, kinds = _Series(), {}, {}
    n = len(rows["flags"])
    refs = [index[x] if x else -1 for x in rows["contig"]]
    ref = refs[0] if len(set(refs)) == 1 else MULTIPLE
    total, low, high = 0, 1 << 31, 0
    op_name = {"I": "IN", "S": "SC", "M": "BB", "=": "BB", "X": "BB"}
    for k in range(n):
        flags, start = rows["flags"][k] or 0, rows["start"][k] or 0
        bases, quals, cigar = (rows[c][k] or "*" for c in ("bases", "quals", "cigar"))
        text = b"" if bases == "*" else bases.encode("latin-1")
        scores = b"" if quals == "*" else bytes(q - 33 for q in quals.encode("latin-1"))
        if scores and len(scores) != len(text):
            raise ValueError(f"{rows['read_name'][k]}: {len(scores)} qualities for {len(text)} bases")
        steps = [(int(m), op) for m, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)] if cigar != "*" and not flags & UNMAPPED else []
        if not steps and text and not flags & UNMAPPED:
            steps = [(len(text), "M")]
        length = len(text) or sum(m for m, op in steps if op in "MIS=X")
        s.number("BF", flags)
        s.number("CF", DETACHED | (QUALITIES if scores else 0) | (0 if text else NO_BASES))
        if ref == MULTIPLE:
            s.number("RI", refs[k])
        s.number("RL", length)
        s.number("AP", start)
        s.number("RG", -1)
        s.sized("RN", (rows["read_name"][k] or "*").encode())
        s.number("MF", (1 if flags & MATE_REVERSED else 0) | (2 if flags & MATE_UNMAPPED else 0))
        mate = rows["mate_contig"][k]
        s.number("NS", index[mate] if mate else -1)
        s.number("NP", rows["mate_start"][k] or 0)
        s.number("TS", rows["insert_size"][k] or 0)
        parts = []
        for tag in (rows["tags"][k] or "").split("\t"):
            if tag:
                raw = encode_tags(tag)
                parts.append((raw[:3], raw[3:]))
        s.number("TL", lines.setdefault(b"".join(t for t, _ in parts), len(lines)))
        for tag, value in parts:
            key = tag[0] << 16 | tag[1] << 8 | tag[2]
            kinds[key] = None
            s.sized(f"tag{key}", value)
        covered = 0
        if flags & UNMAPPED:
            s.put("BA", text)
        else:
            done, place, found = 0, 0, 0
            for m, op in steps:
                code = {"=": "b", "X": "b", "M": "b"}.get(op, op)
                s.put("FC", code.encode())
                s.number("FP", done + 1 - place)
                place, found = done + 1, found + 1
                if op in op_name:
                    s.sized(op_name[op], text[done : done + m] if text else b"N" * m)
                    done += m
                else:
                    s.number({"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[op], m)
                covered += m if op in "MDN=X" else 0
            s.number("FN", found)
            s.number("MQ", 255 if rows["mapq"][k] is None else rows["mapq"][k])
        s.put("QS", scores)
        total += length
        if start > 0:
            low, high = min(low, start), max(high, start + max(covered - 1, 0))
    numbers = {key: i + 1 for i, key in enumerate(sorted(s.data))}
    external = lambda key: put_number(1) + put_number(len(put_number(numbers[key]))) + put_number(numbers[key])

    def sized(key: str) -> bytes:
        own = external(key + "#") + external(key)
        return put_number(4) + put_number(len(own)) + own

    used = [key for key in s.data if not key.endswith("#") and not key.startswith("tag")]
    series = put_number(len(used)) + b"".join(key.encode() + (sized(key) if key in ARRAYS else external(key)) for key in used)
    tags = put_number(len(kinds)) + b"".join(put_number(key) + sized(f"tag{key}") for key in kinds)
    dictionary = b"".join(line + b"\0" for line in lines)
    kept = put_number(5) + b"RN\1AP\0RR\0SM" + bytes([0x1B] * 5) + b"TD" + put_number(len(dictionary)) + dictionary
    sections = b"".join(put_number(len(x)) + x for x in (kept, series, tags))
    span = (low, high - low + 1) if ref >= 0 and high else (0, 0)
    first = block_bytes(COMPRESSION_HEADER, 0, sections)
    ids = [numbers[key] for key in sorted(s.data)]
    head = b"".join(map(put_number, (ref, *span, n))) + put_long(counter) + put_number(len(ids) + 1) + put_numbers(ids) + put_number(-1) + bytes(16)
    body = block_bytes(SLICE_HEADER, 0, head) + block_bytes(CORE, 0, b"") + b"".join(block_bytes(EXTERNAL, numbers[key], bytes(s.data[key])) for key in sorted(s.data))
    return container_bytes(first + body, ref, *span, n, counter, total, len(ids) + 3, [len(first)])

