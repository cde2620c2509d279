"""64-bit hashes of keys, as Arrow functions.

The results follow a fixed variant of the public MurmurHash3 (x64, low half).
It differs from the published one in two ways that stored keys rely on: in full
blocks the second state is rotated with bits of the first one, and the form for
characters takes its tail from the start of the text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed values of the public hash.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
ADD1, ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
FIVE = np.uint64(5)


def _turn(x: np.ndarray, bits: int, low: np.ndarray | None = None) -> np.ndarray:
    """``x`` rotated left; the bits that come in from the right are those of ``low``."""
    return (x << np.uint64(bits)) | ((x if low is None else low) >> np.uint64(64 - bits))


def _stir(words: np.ndarray, first: bool) -> np.ndarray:
    a, b, bits = (C1, C2, 31) if first else (C2, C1, 33)
    return _turn(words * a, bits) * b


def _finish(x: np.ndarray) -> np.ndarray:
    for factor in (MIX1, MIX2):
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _hash(blocks: np.ndarray, n_blocks: np.ndarray, tails: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """``blocks``: rows x blocks x 2 words, ``tails``: rows x 2 words, filled up with 0."""
    with np.errstate(over="ignore"):
        one = two = seeds.astype(np.int64).view(np.uint64)
        for i in range(blocks.shape[1]):
            a = _turn(one ^ _stir(blocks[:, i, 0], True), 27) + two
            a = a * FIVE + ADD1
            b = two ^ _stir(blocks[:, i, 1], False)
            b = (_turn(b, 31, a) + a) * FIVE + ADD2
            live = i < n_blocks
            one, two = np.where(live, a, one), np.where(live, b, two)
        n = lengths.astype(np.uint64)
        one, two = one ^ _stir(tails[:, 0], True) ^ n, two ^ _stir(tails[:, 1], False) ^ n
        one = one + two
        two = two + one
        return (_finish(one) + _finish(two)).view(np.int64)


def murmur_bytes(values: Sequence[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of byte strings; ``seeds`` one for all or one each."""
    n = np.array([len(v) for v in values], np.int64)
    width = int(n.max(initial=0)) // 16 * 16 + 16
    data = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), "<u8").reshape(len(n), -1, 2) if len(n) else np.empty((0, 1, 2), np.uint64)
    full = n // 16
    return _hash(data[:, :-1].copy(), full, data[np.arange(len(n)), full], n, np.broadcast_to(np.asarray(seeds, np.int64), n.shape))


def murmur_chars(values: Sequence[str], seeds: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of texts by their UTF-16 units."""
    units = [v.encode("utf-16-le") for v in values]
    n = np.array([len(u) // 2 for u in units], np.int64)
    width = int(n.max(initial=0)) // 8 * 16 + 16
    data = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), "<u8").reshape(len(n), -1, 2) if len(n) else np.empty((0, 1, 2), np.uint64)
    heads = [u[: len(u) // 2 % 8 * 2].ljust(16, b"\0") for u in units]
    tails = np.frombuffer(b"".join(heads), "<u8").reshape(len(n), 2) if len(n) else np.empty((0, 2), np.uint64)
    return _hash(data.copy(), n // 8, tails, n, np.broadcast_to(np.asarray(seeds, np.int64), n.shape))


def low_int(x: np.ndarray) -> np.ndarray:
    """The low 32 bits as a signed number."""
    return x.astype(np.int64).astype(np.int32).astype(np.int64)


@F.pandas_udf(LongType())
def hash_text(text: pd.Series) -> pd.Series:
    """Hash of a text with seed 0; null stays null, and equal texts of a batch are hashed once."""
    codes, texts = pd.factorize(text)
    found = np.append(murmur_chars(texts.tolist()), 0)
    return pd.Series(found[codes]).where(codes >= 0, None).astype("Int64")


@F.pandas_udf(LongType())
def hash_binary(data: pd.Series) -> pd.Series:
    """Hash of bytes with seed 0; null stays null."""
    return pd.Series(murmur_bytes([bytes(x) if x is not None else b"" for x in data])).where(data.notna().to_numpy(), None).astype("Int64")


def read_hashes(names: Sequence[str], bases: Sequence[str], quals: Sequence[str], cigars: Sequence[str]) -> np.ndarray:
    """The 32-bit hashes of reads without position: name, bases, qualities (as numbers) and CIGAR, each seeding the next; ``*`` has no bases or qualities."""
    bare = lambda x: b"" if x == "*" else x.encode("latin-1")
    h = low_int(murmur_chars(names))
    h = low_int(murmur_bytes([bare(x) for x in bases], h))
    h = low_int(murmur_bytes([bytes(max(c - 33, 0) for c in bare(x)) for x in quals], h))
    return low_int(murmur_chars(cigars, h))


@F.pandas_udf(LongType())
def hash_read(name: pd.Series, bases: pd.Series, quals: pd.Series, cigar: pd.Series) -> pd.Series:
    """``read_hashes`` of the rows with a name; null for the others, which cost nothing."""
    out = pd.Series([None] * len(name), dtype="Int64")
    known = np.flatnonzero(name.notna().to_numpy())
    if len(known):
        of = lambda s: s.iloc[known].fillna("*").tolist()
        out.iloc[known] = read_hashes(of(name), of(bases), of(quals), of(cigar))
    return out
