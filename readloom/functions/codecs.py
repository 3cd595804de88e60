"""Block codecs by name, for bytes and for columns."""

from __future__ import annotations

import bz2
import functools

import pandas as pd
from pyspark.sql import functions as F

from ..schema import SLICE_BYTES

NAMES = ("none", "zstd", "bwt")


@functools.cache
def zstd() -> tuple:
    """A compressor and a decompressor, made once a worker: their tables cost more than a short value."""
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def compress(data: bytes, codec: str) -> bytes:
    """bwt: a Burrows-Wheeler codec of the standard library."""
    if codec == "none" or not data:
        return data
    if codec == "zstd":
        return zstd()[0].compress(data)
    if codec == "bwt":
        return bz2.compress(data)
    raise ValueError(f"unknown codec {codec!r}; there are {', '.join(NAMES)}")


def decompress(data: bytes, codec: str, size: int) -> bytes:
    if codec == "none" or not size:
        out = data
    elif codec == "zstd":
        out = zstd()[1].decompress(data, max_output_size=size)
    elif codec == "bwt":
        out = bz2.decompress(data)
    else:
        raise ValueError(f"unknown codec {codec!r}")
    if len(out) != size:
        raise ValueError("decompressed size does not match")
    return out


def slices(data: bytes, size: int = SLICE_BYTES) -> list[bytes]:
    """data in parts of `size` bytes, each to be compressed alone; no part of nothing."""
    return [data[at : at + size] for at in range(0, len(data), size)]


def compressed(column, codec: str):
    """A binary column, compressed row by row."""

    @F.pandas_udf("binary")
    def run(s):
        return s.map(lambda x: None if x is None else compress(bytes(x), codec))

    return run(column)


def decompressed(column, size, codec: str):
    @F.pandas_udf("binary")
    def run(s, n):
        return pd.Series([None if x is None else decompress(bytes(x), codec, int(k)) for x, k in zip(s, n, strict=True)])

    return run(column, size)


def ratio_percent(part, whole):
    """100 * part / whole; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)
