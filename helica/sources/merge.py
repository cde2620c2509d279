"""One valid file from the part files of a write."""

from __future__ import annotations

import os
import re
import struct

from helica.sources import bgzf
from helica.sources.bam_codec import header_bytes
from helica.sources.bam_index import shift_index
from helica.sources.cram_codec import END, file_start
from helica.sources.files import create, delete_folder, exists, is_remote, join, local, move, names_in, open_file, size_of
from helica.sources.sam import SamHeader

PART = re.compile(r"part-\d+.*")


def part_files(folder: str) -> list[str]:
    """The part files of a finished write in their order; an unfinished one is an error."""
    found = names_in(folder)
    if "_SUCCESS" not in found:
        raise FileNotFoundError(f"{folder} has no _SUCCESS: the write did not finish")
    names = [n for n in found if PART.fullmatch(n) and not n.endswith((".splitting-bai", ".crc"))]
    return [join(folder, n) for n in sorted(names, key=lambda n: (int(re.match(r"part-(\d+)", n)[1]), n))]


def _join(parts: list[str], target: str, head: bytes, tail: bytes) -> list[int]:
    """Write head, parts and tail beside the target and rename; where each part starts."""
    starts, at, work = [], 0, target + ".partial"
    with create(work) as out:
        at += out.write(head)
        for p in parts:
            starts.append(at)
            with open_file(p) as part:
                while data := part.read(1 << 20):
                    at += out.write(data)
        out.write(tail)
    move(work, target)
    return starts


def _check(folder: str, target: str) -> list[str]:
    same = os.path.realpath(os.path.dirname(os.path.abspath(local(target)))) == os.path.realpath(local(folder)) if not is_remote(target) else target.rsplit("/", 1)[0] == folder.rstrip("/")
    if same:
        raise ValueError("the target must not lie in the folder of the parts")
    return part_files(folder)


def merge_reads(folder: str, target: str, header: SamHeader, fmt: str = "bam", delete_parts: bool = False) -> str:
    """Parts without header and terminator as one BAM, SAM or CRAM file, with its splitting index if every part has one.

    The parts stay unless ``delete_parts``. The bytes of the parts are copied as they
    are. Folder and target may be URIs that pyarrow knows.
    """
    parts = _check(folder, target)
    heads = {"bam": lambda: bgzf.compress(header_bytes(header)), "sam": lambda: header.text.encode(), "cram": lambda: file_start(header)}
    tails = {"bam": bgzf.TERMINATOR, "sam": b"", "cram": END}
    if fmt not in heads:
        raise ValueError(f"cannot merge {fmt}")
    starts = _join(parts, target, heads[fmt](), tails[fmt])
    sides = [p + ".splitting-bai" for p in parts]
    if fmt == "bam" and parts and all(map(exists, sides)):
        merge_splitting_indexes(sides, starts, target)
    if delete_parts:
        delete_folder(folder)
    return target


def merge_splitting_indexes(sides: list[str], starts: list[int], target: str) -> None:
    """The index of the merged file: each part's offsets moved to where the part starts."""
    offsets: list[int] = []
    for side, start in zip(sides, starts):
        with open_file(side) as f:
            offsets += shift_index(f.read(), start)
    with create(target + ".splitting-bai") as out:
        out.write(struct.pack(f">{len(offsets) + 1}Q", *offsets, size_of(target) << 16))


def merge_variants(folder: str, target: str, header_text: str, delete_parts: bool = False) -> str:
    """VCF parts without header as one file; the header is compressed as the parts are. BCF parts are an error."""
    parts = _check(folder, target)
    kinds = {bgzf.sniff(p) for p in parts if size_of(p)}
    if len(kinds) > 1:
        raise ValueError(f"parts are compressed in different ways: {sorted(kinds)}")
    kind = next(iter(kinds), "plain")
    for p in parts:
        if size_of(p) and bgzf.head_of(p, 3) == b"BCF":
            raise ValueError("BCF parts cannot be merged")
    head = header_text.encode()
    if kind == "gzip":
        import gzip

        head = gzip.compress(head)
    elif kind == "bgzf":
        head = bgzf.compress(head)
    _join(parts, target, head, bgzf.TERMINATOR if kind == "bgzf" else b"")
    if delete_parts:
        delete_folder(folder)
    return target
