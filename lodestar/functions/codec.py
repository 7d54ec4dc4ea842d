"""Integer codecs for posting blocks: Elias-Fano for document ids, unary for frequencies.

Lists are coded whole, with bits laid out by numpy; the columns are binary. Parquet's own encodings are the better
choice for storage; these give byte-compatible blocks and their sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a positional read past the end gives.
END = 2147483647


def round_up(bits: int) -> int:
    """The next multiple of 8, 8 for 0."""
    return max(8, -(-bits // 8) * 8)


def low_width(u: int, n: int) -> int:
    """Bits of the low part of each of n ids up to u."""
    return math.ceil(math.log(u / n) / math.log(2))


def elias_fano_size(u: int, n: int) -> int:
    return (round_up(low_width(u + 1, n) * n) + round_up(2 * n)) // 8


def unary_size(values) -> int:
    return max(1, -(-(int(np.sum(values)) + len(values)) // 8))


def elias_fano(ids) -> bytes:
    """The ids, ascending: their low bits packed from a byte border, then from the next one a one for each id in its
    cluster of equal high part, with a zero ending each cluster, empty ones included."""
    x = np.asarray(ids, dtype=np.int64)
    if not len(x):
        return b""
    width = low_width(int(x[-1]), len(x))
    start = round_up(width * len(x))
    high = x >> width
    ones = start + high + np.arange(len(x))
    bits = np.zeros(max(8 * elias_fano_size(int(x[-1]), len(x)), round_up(int(ones[-1]) + 2)), np.uint8)
    if width:
        bits[: width * len(x)] = ((x[:, None] >> np.arange(width - 1, -1, -1)) & 1).ravel()
    bits[ones] = 1
    return np.packbits(bits)[: max(elias_fano_size(int(x[-1]), len(x)), int(ones[-1]) // 8 + 1)].tobytes()


def elias_fano_decode(data: bytes, n: int, u: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(np.int64)
    width = low_width(u, n)
    low = np.zeros(n, np.int64)
    if width:
        low = bits[: width * n].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))
    ones = np.flatnonzero(bits[round_up(width * n) :])[:n]
    return (ones - np.arange(n)) << width | low


def elias_fano_get(data: bytes, n: int, u: int, i: int) -> int:
    return int(elias_fano_decode(data, n, u)[i]) if 0 <= i < n else END


def unary(values) -> bytes:
    """Each value as that many ones and a zero."""
    v = np.asarray(values, dtype=np.int64)
    bits = np.ones(8 * unary_size(v), np.uint8)
    total = int(v.sum()) + len(v)
    bits[np.cumsum(v + 1) - 1] = 0
    bits[total:] = 0
    return np.packbits(bits).tobytes()


def unary_decode(data: bytes, n: int) -> np.ndarray:
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)) == 0)[:n]
    return np.diff(np.r_[-1, zeros]) - 1


def unary_get(data: bytes, n: int, i: int) -> int:
    return int(unary_decode(data, n)[i])


def read_bits(data: bytes, at: int, n: int) -> int:
    """The number that n bits from bit `at` on make, the highest first."""
    first, last = at // 8, -(-(at + n) // 8)
    return int.from_bytes(data[first:last]) >> (8 * last - at - n) & ((1 << n) - 1)


def write_bits(data: bytearray, at: int, n: int, value: int) -> int:
    """Set n bits from bit `at` on to a number; the bit after them."""
    first, last = at // 8, -(-(at + n) // 8)
    shift = 8 * last - at - n
    kept = int.from_bytes(data[first:last]) & ~(((1 << n) - 1) << shift)
    data[first:last] = (kept | value << shift).to_bytes(last - first)
    return at + n


def read_unary(data: bytes, at: int) -> tuple[int, int]:
    """The ones from bit `at` on up to a zero, and the bit after it."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at // 8))[at % 8 :]
    n = int(np.argmin(bits))
    return n, at + n + 1


def write_unary(data: bytearray, at: int, value: int) -> int:
    """Set the bits from `at` on to that many ones and a zero; the bit after it."""
    return write_bits(data, at, value + 1, (1 << value + 1) - 2)


def encode_ids(ids: Column) -> Column:
    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(elias_fano, na_action="ignore")

    return run(ids)


def decode_ids(data: Column, n: Column, u: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(raw: pd.Series, ns: pd.Series, us: pd.Series) -> pd.Series:
        return pd.Series([elias_fano_decode(d, a, b) for d, a, b in zip(raw, ns, us, strict=True)])

    return run(data, n, u)


def encode_freqs(freqs: Column) -> Column:
    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(unary, na_action="ignore")

    return run(freqs)


def decode_freqs(data: Column, n: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(raw: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([unary_decode(d, a) for d, a in zip(raw, ns, strict=True)])

    return run(data, n)


def low_width_column(u: Column, n: Column) -> Column:
    return F.ceil(F.log(u.cast("double") / n) / F.lit(math.log(2)))


def round_up_column(bits: Column) -> Column:
    return F.greatest(F.lit(8).cast("bigint"), F.ceil(bits / 8).cast("bigint") * 8)


def elias_fano_size_column(u: Column, n: Column) -> Column:
    return ((round_up_column(low_width_column(u + 1, n) * n) + round_up_column(2 * n)) / 8).cast("bigint")


def unary_size_column(total: Column, n: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil((total + n) / 8).cast("bigint"))
