"""BAM records between bytes and Arrow columns."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

from helica.functions.hashing import read_hashes
from helica.functions.keys import NO_POSITION, UNMAPPED
from helica.sources.bgzf import Blocks
from helica.sources.files import stamp
from helica.sources.sam import SamHeader

#: Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
CIGAR_OPS = "MIDNSHP=X"
COVERS_REFERENCE = (True, False, True, True, False, False, False, True, True)
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name_len", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flags", "<u2"), ("n_bases", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("insert", "<i4")])
MAX_STEPS = 65535
TAG_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}

_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)
_CODE = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def parse_header(data: bytes) -> tuple[SamHeader, int] | None:
    """Header and its length in bytes; None if ``data`` ends before it does."""
    if len(data) < 12:
        return None
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n_text = struct.unpack_from("<i", data, 4)[0]
    at = 8 + n_text
    if len(data) < at + 4:
        return None
    text = data[8:at].rstrip(b"\0").decode()
    n_ref, at = struct.unpack_from("<i", data, at)[0], at + 4
    contigs = []
    for _ in range(n_ref):
        if len(data) < at + 4:
            return None
        n = struct.unpack_from("<i", data, at)[0]
        if len(data) < at + 8 + n:
            return None
        contigs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    return SamHeader(text, contigs), at


def header_bytes(header: SamHeader) -> bytes:
    """Magic, text and the dictionary of a BAM file."""
    text = header.text.encode()
    refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in header.contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(header.contigs)) + refs


def read_bam_header(path: str) -> tuple[SamHeader, int]:
    """The header, and the virtual offset of the first record. A process reads the header of a file once, whatever its size."""
    return _header_of_file(path, stamp(path))


@lru_cache(maxsize=64)
def _header_of_file(path: str, _stamp: tuple) -> tuple[SamHeader, int]:
    data, marks, need = bytearray(), [], 12
    for address, n, block in Blocks(path):
        marks.append((len(data), address, address + n))
        data += block
        if len(data) < need:
            continue
        if len(marks) == 1 or need == 12:
            if bytes(data[:4]) != b"BAM\1":
                raise ValueError("not a BAM file")
            need = 12 + struct.unpack_from("<i", data, 4)[0]
            if len(data) < need:
                continue
        found = parse_header(bytes(data))
        if found:
            header, length = found
            if length == len(data):
                return header, marks[-1][2] << 16
            begin, where, _ = marks[-1]
            return header, (where << 16) | (length - begin)
        need = 2 * len(data)  # the dictionary is still open: parsed again only when it has doubled
    found = parse_header(bytes(data)) if data else None
    if found:
        header, length = found
        begin, where, after = next(m for m in reversed(marks) if m[0] < length or m[0] == 0)
        return header, after << 16 if length == len(data) else (where << 16) | (length - begin)
    raise ValueError(f"{path} ends inside its header")


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def text_of(raw: bytes) -> str:
    """UTF-8; bytes that are none are taken as Latin-1."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _strings(flat: np.ndarray, lengths: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Arrow texts from their bytes one after the other; ``missing`` ones are ``*``."""
    if missing is None and flat.max(initial=0) > 127:
        ends, pieces = np.cumsum(lengths), flat.tobytes()
        return pa.array([text_of(pieces[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.string())
    if missing is not None and missing.any():
        offsets = np.cumsum(lengths)
        pieces = flat.tobytes()
        return pa.array(["*" if m else pieces[e - n : e].decode("latin-1") for m, e, n in zip(missing, offsets, lengths)], pa.string())
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))


@lru_cache(maxsize=1 << 16)
def _cigar(raw: bytes) -> tuple[str, int]:
    steps = [(x >> 4, x & 15) for x in struct.unpack(f"<{len(raw) // 4}I", raw)]
    return "".join(f"{n}{CIGAR_OPS[o]}" for n, o in steps) or "*", sum(n for n, o in steps if COVERS_REFERENCE[o])


def decode_tags(raw: bytes) -> str:
    """Optional fields as SAM text."""
    out, at = [], 0
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{tag}:A:{chr(raw[at])}")
            at += 1
        elif kind in TAG_NUMBERS:
            form = TAG_NUMBERS[kind]
            value = struct.unpack_from(form, raw, at)[0]
            out.append(f"{tag}:f:{value:.7g}" if kind == "f" else f"{tag}:i:{value}")
            at += struct.calcsize(form)
        elif kind in "ZH":
            end = raw.index(0, at)
            out.append(f"{tag}:{kind}:{text_of(raw[at:end])}")
            at = end + 1
        elif kind == "B":
            sub = chr(raw[at])
            n = struct.unpack_from("<i", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{TAG_NUMBERS[sub][1]}", raw, at + 5)
            out.append(f"{tag}:B:{sub}" + "".join(f",{v:.7g}" if sub == "f" else f",{v}" for v in values))
            at += 5 + n * struct.calcsize(TAG_NUMBERS[sub])
        else:
            raise ValueError(f"unknown type of tag {tag}: {kind}")
    return "\t".join(out)


def _tag_end(raw: bytes, at: int) -> int:
    """Where the optional field that starts at ``at`` ends."""
    kind = chr(raw[at + 2])
    if kind == "A":
        return at + 4
    if kind in TAG_NUMBERS:
        return at + 3 + struct.calcsize(TAG_NUMBERS[kind])
    if kind in "ZH":
        return raw.index(0, at + 3) + 1
    if kind == "B":
        return at + 8 + struct.unpack_from("<i", raw, at + 4)[0] * struct.calcsize(TAG_NUMBERS[chr(raw[at + 3])])
    raise ValueError(f"unknown type of tag {raw[at : at + 2].decode('latin-1')}: {kind}")


def _long_cigar(raw: bytes) -> tuple[bytes, bytes] | None:
    """The CIGAR that the optional field CG holds, and the other fields; None if there is no such field."""
    at = 0
    while at + 3 <= len(raw):
        end = _tag_end(raw, at)
        if raw[at : at + 4] == b"CGBI":
            return raw[at + 8 : end], raw[:at] + raw[end:]
        at = end
    return None


def encode_tags(text: str | None) -> bytes:
    """The binary form of optional fields in SAM text; whole numbers are stored as 32 bits."""
    out = []
    for part in (text or "").split("\t"):
        if not part:
            continue
        tag, kind, value = part.split(":", 2)
        head = tag.encode("latin-1")
        if kind == "A":
            out.append(head + b"A" + value.encode("latin-1"))
        elif kind == "i":
            n = int(value)
            out.append(head + (b"i" + struct.pack("<i", n) if n < 2**31 else b"I" + struct.pack("<I", n)))
        elif kind == "f":
            out.append(head + b"f" + struct.pack("<f", float(value)))
        elif kind in "ZH":
            out.append(head + kind.encode() + value.encode() + b"\0")
        elif kind == "B":
            sub, *values = value.split(",")
            cast = float if sub == "f" else int
            out.append(head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{TAG_NUMBERS[sub][1]}", len(values), *map(cast, values)))
        else:
            raise ValueError(f"unknown type of tag: {part}")
    return b"".join(out)


def decode_records(data: bytes, offsets: np.ndarray, header: SamHeader, columns: set[str] | None = None) -> pa.RecordBatch:
    """The records that start at ``offsets`` of ``data`` as a batch of reads.

    Fields of fixed size, names, bases and qualities are taken for all records at
    once. Columns not in ``columns`` are null and cost nothing. CIGARs that stand
    in the optional field CG, as more steps than the fixed fields count, come as such.
    """
    want = (lambda c: True) if columns is None else columns.__contains__
    raw = np.frombuffer(data, np.uint8)
    n = len(offsets)
    f = raw[offsets[:, None] + np.arange(FIXED.itemsize)].copy().view(FIXED).reshape(n) if n else np.empty(0, FIXED)
    name_at = offsets + 36
    cigar_at = name_at + f["name_len"]
    bases_at = cigar_at + 4 * f["n_cigar"].astype(np.int64)
    n_bases = f["n_bases"].astype(np.int64)
    half = (n_bases + 1) // 2
    quals_at = bases_at + half
    tags_at, end = quals_at + n_bases, offsets + 4 + f["size"]
    names = pa.array(header.names, pa.string())
    long: dict[int, tuple[bytes, bytes]] = {}
    if want("cigar") or want("end") or want("tags"):
        two = np.flatnonzero(f["n_cigar"] == 2)
        steps = raw[cigar_at[two][:, None] + np.arange(8)].copy().view("<u4").reshape(-1, 2).astype(np.int64)
        two = two[(steps[:, 0] == (n_bases[two] << 4 | CIGAR_OPS.index("S"))) & (steps[:, 1] & 15 == CIGAR_OPS.index("N"))]
        long = {i: found for i in two.tolist() if (found := _long_cigar(data[tags_at[i] : end[i]]))}

    def contigs(index: np.ndarray) -> pa.Array:
        if not len(names):
            return pa.nulls(n, pa.string())
        return names.take(pa.array(np.where(index >= 0, index, 0), mask=index < 0))

    def nulls(kind: pa.DataType = pa.string()) -> pa.Array:
        return pa.nulls(n, kind)

    start = f["pos"].astype(np.int64) + 1
    cigar, span = nulls(), np.zeros(n, np.int64)
    if want("cigar") or want("end"):
        both = [_cigar(data[a : a + 4 * k]) for a, k in zip(cigar_at.tolist(), f["n_cigar"].tolist())]
        for i, (whole, _) in long.items():
            both[i] = _cigar.__wrapped__(whole)
        cigar = pa.array([c for c, _ in both], pa.string())
        span = np.array([s for _, s in both], np.int64).reshape(n)
    bases = quals = nulls()
    if want("bases"):
        letters = _PAIRS[_gather(raw, bases_at, half)].reshape(-1)
        if (n_bases % 2).any():
            ends = np.cumsum(2 * half)
            keep = np.ones(len(letters), bool)
            keep[ends[n_bases % 2 == 1] - 1] = False
            letters = letters[keep]
        bases = _strings(letters, n_bases, n_bases == 0)
    if want("quals"):
        scores = _gather(raw, quals_at, n_bases)
        first = np.full(n, 255, np.uint8)
        first[n_bases > 0] = raw[quals_at[n_bases > 0]]
        quals = _strings((scores + 33).astype(np.uint8), n_bases, (n_bases == 0) | (first == 255))
    tags = pa.array([decode_tags(long[i][1] if i in long else data[a:b]) for i, (a, b) in enumerate(zip(tags_at.tolist(), end.tolist()))], pa.string()) if want("tags") else nulls()
    name_bytes = f["name_len"].astype(np.int64) - 1
    read_names = _strings(_gather(raw, name_at, name_bytes), name_bytes)
    key = nulls(pa.int64())
    if want("key"):
        value = np.where(start < 1, start - 1, (f["ref"].astype(np.int64) << 32) | (start - 1))
        lost = np.flatnonzero(((f["flags"] & UNMAPPED) != 0) | (f["ref"] < 0) | (start < 0))
        if len(lost):
            of = decode_records(data, offsets[lost], header, {"bases", "quals", "cigar"})
            value[lost] = (NO_POSITION << 32) | read_hashes(*(of[c].to_pylist() for c in ("read_name", "bases", "quals", "cigar")))
        key = pa.array(value)
    i32 = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            read_names, i32(f["flags"]), i32(f["ref"]), contigs(f["ref"]), i32(start), i32(start + np.maximum(span - 1, 0)),
            i32(f["mapq"]), cigar, i32(f["mate_ref"]), contigs(f["mate_ref"]), i32(f["mate_pos"].astype(np.int64) + 1), i32(f["insert"]), bases, quals, tags, key,
        ],
        ["read_name", "flags", "ref_index", "contig", "start", "end", "mapq", "cigar", "mate_ref_index", "mate_contig", "mate_start", "insert_size", "bases", "quals", "tags", "key"],
    )


@lru_cache(maxsize=1 << 16)
def _cigar_bytes(text: str) -> tuple[bytes, int]:
    """The binary form of a CIGAR, and the reference positions it covers."""
    steps = [] if text == "*" else [(int(k), CIGAR_OPS.index(o)) for k, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]
    return b"".join(struct.pack("<I", k << 4 | o) for k, o in steps), sum(k for k, o in steps if COVERS_REFERENCE[o])


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and their lengths."""
    joined = "".join(texts).encode("latin-1")
    return np.frombuffer(joined, np.uint8), np.array([len(t) for t in texts], np.int64)


def _put(out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
    """Write slices that come one after the other to many places."""
    ends = np.cumsum(lengths)
    out[np.arange(len(flat)) + np.repeat(starts - (ends - lengths), lengths)] = flat


def _bins(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``smallest_bin`` of many records; 4680 for those without a position."""
    last = np.maximum(end - 1, begin)
    out = np.zeros(len(begin), np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(begin >> shift == last >> shift, first + (begin >> shift), out)
    return np.where(begin < 0, 4680, out)


def encode_batch(batch: pa.RecordBatch, index: dict[str, int]) -> tuple[bytes, np.ndarray]:
    """Reads as BAM records with their lengths in front, and where each starts.

    Fields of all reads are laid out at once; only names of contigs, distinct
    CIGARs and tags are looked at one by one. A CIGAR of more than 65535 steps goes to the
    optional field CG, and its place takes the lengths of the read and of what it covers.
    """
    n = batch.num_rows
    text = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("read_name", "contig", "mate_contig", "cigar", "bases", "quals", "tags")}

    def number(c: str, default: int) -> np.ndarray:
        return batch.column(batch.schema.get_field_index(c)).fill_null(default).to_numpy(zero_copy_only=False).astype(np.int64)

    def refs(c: str) -> np.ndarray:
        missing = {x for x in set(text[c]) if x and x not in index}
        if missing:
            raise ValueError(f"contigs are not in the header: {sorted(missing)}")
        return np.array([index[x] if x else -1 for x in text[c]], np.int64)

    raw_names = [(x or "*").encode() + b"\0" for x in text["read_name"]]
    names, name_len = np.frombuffer(b"".join(raw_names), np.uint8), np.array([len(x) for x in raw_names], np.int64)
    if name_len.max(initial=0) > 255:
        raise ValueError(f"{text['read_name'][int(name_len.argmax())]}: BAM has no names over 254 bytes")
    cigars = [(_cigar_bytes if len(x or "*") <= 2 * MAX_STEPS else _cigar_bytes.__wrapped__)(x or "*") for x in text["cigar"]]
    long = {i: c for i, (c, _) in enumerate(cigars) if len(c) > 4 * MAX_STEPS}
    for i in long:
        n_read = len(text["bases"][i]) if text["bases"][i] not in (None, "*") else 0
        cigars[i] = struct.pack("<II", n_read << 4 | CIGAR_OPS.index("S"), cigars[i][1] << 4 | CIGAR_OPS.index("N")), cigars[i][1]
    cigar, cigar_len = np.frombuffer(b"".join(c for c, _ in cigars), np.uint8), np.array([len(c) for c, _ in cigars], np.int64)
    span = np.maximum(np.array([s for _, s in cigars], np.int64), 1)
    bases = ["" if x in (None, "*") else x for x in text["bases"]]
    n_bases = np.array([len(x) for x in bases], np.int64)
    codes = _CODE[_flat([x + "=" if len(x) % 2 else x for x in bases])[0]]
    packed, half = (codes[::2] << 4) | codes[1::2], (n_bases + 1) // 2
    quals = ["\xff" * k if q in (None, "*") else q for q, k in zip(text["quals"], n_bases.tolist())]
    known = np.array([q not in (None, "*") for q in text["quals"]], bool)
    scores, qual_len = _flat(quals)
    wrong = np.flatnonzero(qual_len != n_bases)
    if len(wrong):
        raise ValueError(f"{text['read_name'][wrong[0]]}: {qual_len[wrong[0]]} qualities for {n_bases[wrong[0]]} bases")
    scores = np.where(np.repeat(known, qual_len), scores - 33, scores).astype(np.uint8)
    tags = [encode_tags(x) for x in text["tags"]]
    for i, c in long.items():
        tags[i] += b"CGBI" + struct.pack("<i", len(c) // 4) + c
    tag_len = np.array([len(x) for x in tags], np.int64)
    sizes = 36 + name_len + cigar_len + half + n_bases + tag_len
    starts = np.cumsum(sizes) - sizes
    begin = number("start", 0) - 1
    head = np.zeros(n, FIXED)
    for field_name, values in (("size", sizes - 4), ("ref", refs("contig")), ("pos", begin), ("name_len", name_len), ("mapq", number("mapq", 255)), ("bin", _bins(begin, begin + span)), ("n_cigar", cigar_len // 4), ("flags", number("flags", 0)), ("n_bases", n_bases), ("mate_ref", refs("mate_contig")), ("mate_pos", number("mate_start", 0) - 1), ("insert", number("insert_size", 0))):
        head[field_name] = values
    out = np.zeros(int(sizes.sum()), np.uint8)
    _put(out, starts, np.full(n, FIXED.itemsize, np.int64), head.view(np.uint8))
    at = starts + FIXED.itemsize
    for flat, lengths in ((names, name_len), (cigar, cigar_len), (packed, half), (scores, n_bases), (np.frombuffer(b"".join(tags), np.uint8), tag_len)):
        _put(out, at, lengths, flat)
        at = at + lengths
    return out.tobytes(), starts


def plausible(data: bytes, at: int, n_refs: int) -> bool:
    """Whether the bytes at ``at`` can be a record: references in range, a name with its end, lengths that fit."""
    if at + 36 > len(data):
        return False
    size, ref, pos, name_len, _, _, n_cigar, _, n_bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name_len >= 1 and n_bases >= 0):
        return False
    if size < 32 + name_len + 4 * n_cigar + n_bases + (n_bases + 1) // 2:
        return False
    end = at + 36 + name_len
    if end > len(data):
        return False
    name = data[at + 36 : end - 1]
    return data[end - 1] == 0 and all(c >= 33 and c != 127 for c in name)
