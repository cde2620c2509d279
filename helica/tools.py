"""Small commands on single files: ``python -m helica.tools <command> ...``."""

from __future__ import annotations

import argparse
import sys

from helica.sources import bgzf
from helica.sources.bam import bam_kind
from helica.sources.bam_codec import read_bam_header
from helica.sources.bam_index import DEFAULT_GRANULARITY, BlockIndex, SplittingIndex, build_bai, build_block_index, build_splitting_index, build_tabix
from helica.sources.bcf import Dictionary, bcf_kind, read_bcf_header
from helica.sources.files import size_of
from helica.sources.reads import read_sam_header
from helica.sources.records import first_record


def _write(path: str, data: bytes) -> None:
    with open(path, "wb") as out:
        out.write(data)
    print(path)


def _show(offset: int) -> str:
    return f"{offset >> 16}:{offset & 0xFFFF}"


def _first(path: str, address: int, variants: bool) -> int:
    """The virtual offset of the first record at or after an address of a BAM or BCF file."""
    if variants:
        header, begin = read_bcf_header(path)
        return first_record(path, address, size_of(path), bcf_kind(Dictionary.of(header), len(header.samples)), begin)
    header, begin = read_bam_header(path)
    return first_record(path, address, size_of(path), bam_kind(header), begin)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="helica.tools", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index-records", "index-blocks"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--granularity", type=int, default=DEFAULT_GRANULARITY)
    for name in ("index-bai", "index-tabix", "show-records", "show-blocks", "blocks"):
        commands.add_parser(name).add_argument("path")
    for name in ("first-read", "first-variant"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("address", type=int)
    c = commands.add_parser("header")
    c.add_argument("path")
    c.add_argument("--sorted-by")
    a = parser.parse_args(args)
    if a.command == "index-records":
        _write(a.path + ".splitting-bai", build_splitting_index(a.path, a.granularity))
    elif a.command == "index-blocks":
        _write(a.path + ".bgzfi", build_block_index(a.path, a.granularity))
    elif a.command == "index-bai":
        _write(a.path + ".bai", build_bai(a.path))
    elif a.command == "index-tabix":
        _write(a.path + ".tbi", build_tabix(a.path))
    elif a.command == "show-records":
        print(*map(_show, SplittingIndex.read(a.path).offsets), sep="\n")
    elif a.command == "show-blocks":
        print(*BlockIndex.read(a.path).offsets, sep="\n")
    elif a.command == "blocks":
        for address, n, length in bgzf.block_addresses(a.path):
            print(address, n, length)
    elif a.command in ("first-read", "first-variant"):
        print(_show(_first(a.path, a.address, a.command == "first-variant")))
    else:
        header = read_sam_header(a.path)
        print((header.sorted_by(a.sorted_by) if a.sorted_by else header).text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
