"""Formats of read and variant files, by name and by first bytes."""

from __future__ import annotations

from helica.sources.bgzf import head_of
from helica.sources.files import open_file

READ_NAMES = {".bam": "bam", ".cram": "cram", ".sam": "sam"}
VARIANT_NAMES = {".bcf": "bcf", ".vcf": "vcf", ".gz": "vcf", ".bgz": "vcf"}


def _by_name(path: str, names: dict[str, str]) -> str | None:
    return next((kind for end, kind in names.items() if path.endswith(end)), None)


def read_format_of_name(path: str) -> str | None:
    return _by_name(path, READ_NAMES)


def variant_format_of_name(path: str) -> str | None:
    return _by_name(path, VARIANT_NAMES)


def read_format_of_data(path: str) -> str | None:
    """bam, cram or sam from the first byte; None for anything else."""
    with open_file(path) as f:
        return {b"\x1f": "bam", b"C": "cram", b"@": "sam"}.get(f.read(1))


def variant_format_of_data(path: str) -> str | None:
    """bcf or vcf from the first byte, behind compression if there is one."""
    return {b"B": "bcf", b"#": "vcf"}.get(head_of(path, 1))


def read_format(path: str, trust_names: bool = True, formats: dict[str, str] | None = None) -> str | None:
    """The format of a read file. With a map ``formats`` a path that is not in it is an error."""
    if formats is not None:
        if path not in formats:
            raise ValueError(f"no format is given for {path}")
        return formats[path]
    return (read_format_of_name(path) if trust_names else None) or read_format_of_data(path)


def variant_format(path: str, trust_names: bool = True, formats: dict[str, str] | None = None) -> str | None:
    """As ``read_format``, for variant files."""
    if formats is not None:
        if path not in formats:
            raise ValueError(f"no format is given for {path}")
        return formats[path]
    return (variant_format_of_name(path) if trust_names else None) or variant_format_of_data(path)
