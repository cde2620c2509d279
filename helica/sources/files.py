"""Opening files by path or URI, and byte ranges of them."""

from __future__ import annotations

import glob
import os
import re
import shutil
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition

SPLIT_BYTES = 64 << 20
#: Files that stand beside the data and are not data.
SIDE_FILES = (".splitting-bai", ".bai", ".bgzfi", ".tbi", ".csi", ".fai")


@dataclass
class ByteRange(InputPartition):
    """Bytes ``[start, end)`` of a file; ``size`` is its whole length."""

    path: str
    start: int
    end: int
    size: int


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:/") else path


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def open_file(path: str):
    """A seekable binary file; ``path`` may be a URI that pyarrow knows."""
    if is_remote(path):
        where, name = _filesystem(path)
        return where.open_input_file(name)
    return open(local(path), "rb")


def size_of(path: str) -> int:
    if is_remote(path):
        where, name = _filesystem(path)
        return where.get_file_info(name).size
    return os.path.getsize(local(path))


def stamp(path: str) -> tuple:
    """What changes when a file is written again: its size and time."""
    if is_remote(path):
        where, name = _filesystem(path)
        info = where.get_file_info(name)
        return info.size, info.mtime_ns
    found = os.stat(local(path))
    return found.st_size, found.st_mtime_ns


def exists(path: str) -> bool:
    if is_remote(path):
        where, name = _filesystem(path)
        return where.get_file_info(name).is_file
    return os.path.exists(local(path))


def create(path: str):
    """A new binary file to write."""
    if is_remote(path):
        where, name = _filesystem(path)
        return where.open_output_stream(name)
    return open(local(path), "wb")


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def make_folder(path: str) -> None:
    if is_remote(path):
        where, name = _filesystem(path)
        where.create_dir(name, recursive=True)
    else:
        os.makedirs(local(path), exist_ok=True)


def names_in(folder: str) -> list[str]:
    """The names of the files in a folder; none if there is no such folder."""
    if is_remote(folder):
        from pyarrow import fs

        where, name = _filesystem(folder)
        return [i.base_name for i in where.get_file_info(fs.FileSelector(name, allow_not_found=True))]
    return os.listdir(local(folder)) if os.path.isdir(local(folder)) else []


def move(path: str, target: str) -> None:
    """Rename a file, over another if there is one."""
    if is_remote(path):
        where, name = _filesystem(path)
        where.move(name, _filesystem(target)[1])
    else:
        os.replace(local(path), local(target))


def delete(path: str) -> None:
    if is_remote(path):
        where, name = _filesystem(path)
        where.delete_file(name)
    else:
        os.remove(local(path))


def delete_folder(path: str) -> None:
    if is_remote(path):
        where, name = _filesystem(path)
        where.delete_dir(name)
    else:
        shutil.rmtree(local(path))


def read_range(path: str, start: int, length: int) -> bytes:
    with open_file(path) as f:
        f.seek(start)
        return f.read(length)


def expand(path: str) -> list[str]:
    """The data files of a comma-separated list of files, folders and patterns, sorted; hidden and index files are left out."""
    found: list[str] = []
    for part in path.split(","):
        if is_remote(part):
            from pyarrow import fs

            where, name = _filesystem(part)
            info = where.get_file_info(name)
            scheme = part[: part.index("://") + 3]
            found += [part] if info.is_file else [scheme + i.path for i in where.get_file_info(fs.FileSelector(name)) if i.is_file]
            continue
        plain = local(part)
        if os.path.isdir(plain):
            found += [os.path.join(plain, n) for n in os.listdir(plain)]
        else:
            hits = glob.glob(plain)
            if not hits:
                raise FileNotFoundError(part)
            found += hits
    names = [(os.path.basename(f), f) for f in found]
    return sorted(f for n, f in names if not n.startswith(("_", ".")) and not n.endswith(SIDE_FILES))


def byte_ranges(path: str, split: int = SPLIT_BYTES, splittable: bool = True) -> list[ByteRange]:
    """Ranges of at most ``split`` bytes over all files of ``path``; empty files have none."""
    ranges = []
    for f in expand(path):
        size = size_of(f)
        step = split if splittable else max(size, 1)
        ranges += [ByteRange(f, a, min(a + step, size), size) for a in range(0, size, step)]
    return ranges


#: A line and its end: LF, CR, or both.
LINE = re.compile(rb"([^\r\n]*)(?:\r\n|\n|\r)")


def _line_blocks(f, base: int, chunk: int):
    """(offset, bytes) of stretches of whole lines; the last may lack its end. A long line is joined once."""
    pending: list[bytes] = []
    while data := f.read(chunk):
        if data.endswith(b"\r"):
            data += f.read(1)  # the LF of a CR LF stays with it
        cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, len(data))) + 1
        if not cut:
            pending.append(data)
            continue
        block = b"".join([*pending, data[:cut]])
        pending = [data[cut:]]
        yield base, block
        base += len(block)
    rest = b"".join(pending)
    if rest:
        yield base, rest


def sliced_lines(path: str, start: int, end: int, chunk: int = 1 << 20):
    """(offset, line) of the lines that begin in ``[start, end)``, without LF, CR or CR LF; the last is read to its end.

    A line belongs to the range of its first byte: every range skips the line
    that began before it.
    """
    with open_file(path) as f:
        skip = start > 0
        base = start - 1 if skip else 0
        f.seek(base)
        for at, block in _line_blocks(f, base, chunk):
            if b"\r" not in block:
                lines = ((len(x) + 1, x) for x in block.removesuffix(b"\n").split(b"\n"))
            else:
                whole = [(m.end() - m.start(), m[1]) for m in LINE.finditer(block)]
                rest = block[sum(n for n, _ in whole) :]
                lines = [*whole, (len(rest), rest)] if rest else whole
            for n, line in lines:
                here, at = at, at + n
                if skip:
                    skip = False
                    continue
                if here >= end:
                    return
                yield here, line
