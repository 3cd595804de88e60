"""Encodings of columns: as SQL expressions where a row is a value, by numpy a chunk where bytes are packed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import N_BLOCK


def order() -> Window:
    return Window.partitionBy("chunk_id", "col").orderBy("rec")


def int_deltas(columns: DataFrame) -> DataFrame:
    """Of int32 identifier columns: the first value, then differences, wrapped to 32 bits."""
    d = F.col("value").cast("long") - F.coalesce(F.lag("value").over(order()).cast("long"), F.lit(0))
    return columns.where("kind = 'int32'").select("chunk_id", "rec", "col", "value", wrapped(d).alias("delta"))


def wrapped(x: Column) -> Column:
    return ((F.pmod(x + F.lit(1 << 31), F.lit(1 << 32))) - F.lit(1 << 31)).cast("int")


def ints_restored(deltas: DataFrame) -> DataFrame:
    """Running sums; a sum outside int32 fails the job."""
    v = F.sum(F.col("delta").cast("long")).over(order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return deltas.select("chunk_id", "rec", "col", F.when(v.between(-(1 << 31), (1 << 31) - 1), v.cast("int")).otherwise(F.raise_error(F.lit("delta decoding overflows int32")).cast("int")).alias("value"))


def zigzag(v: Column) -> Column:
    """Unsigned 32-bit zigzag of an int, as a long."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)).bitwiseAND(F.lit(0xFFFFFFFF))


def unzigzag(z: Column) -> Column:
    return F.shiftright(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1))).cast("int")


def varint_size(z: Column) -> Column:
    return F.when(z < 1 << 7, 1).when(z < 1 << 14, 2).when(z < 1 << 21, 3).when(z < 1 << 28, 4).otherwise(5)


def by_chunk(df: DataFrame, keys: list[str], schema: str, make) -> DataFrame:
    """A chunk's rows, in order of rec, to make(keys, table) -> dict of columns. A chunk is bounded."""

    def run(key, table):
        return pa.table(make(tuple(k.as_py() for k in key), table.sort_by("rec")), schema=arrow(schema))

    return df.groupBy(*keys).applyInArrow(run, schema)


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in schema.split(","))])


def stream(table: pa.Table, column: str) -> bytes:
    """A text column's values, one after another."""
    return b"".join((v or "").encode() for v in table[column].to_pylist())


def varint_streams(deltas: DataFrame) -> DataFrame:
    """chunk_id, col, n, bytes: zigzag varints of the deltas, one after another."""

    def make(key, t):
        d = t["delta"].to_numpy()
        return {"chunk_id": [key[0]], "col": [key[1]], "n": [len(d)], "bytes": [kernels.varint(kernels.zigzag(d))]}

    return by_chunk(deltas.select("chunk_id", "col", "rec", "delta"), ["chunk_id", "col"], "chunk_id int, col int, n long, bytes binary", make)


def varints_read(streams: DataFrame) -> DataFrame:
    """chunk_id, col, k, delta: the inverse, in order."""

    def run(batches):
        for b in batches:
            for c, col, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                d = kernels.unzigzag(kernels.unvarint(data, n))
                yield pa.record_batch({"chunk_id": pa.array([c] * n, pa.int32()), "col": pa.array([col] * n, pa.int32()), "k": pa.array(np.arange(n)), "delta": pa.array(d)})

    return streams.select("chunk_id", "col", "n", "bytes").mapInArrow(run, "chunk_id int, col int, k long, delta int")


def packed(reads: DataFrame, pack_order: str = "tgca") -> DataFrame:
    """chunk_id, bases, packed: two bits a base, over the chunk's reads one after another."""

    def make(key, t):
        s = stream(t, "basecalls")
        return {"chunk_id": [key[0]], "bases": [len(s)], "packed": [kernels.pack(s, pack_order)]}

    return by_chunk(reads.select("chunk_id", "rec", "basecalls"), ["chunk_id"], "chunk_id int, bases long, packed binary", make)


def n_counts(reads: DataFrame, block: int = N_BLOCK) -> DataFrame:
    """chunk_id, blk, n_count: N's in each block of the chunk's basecalls, blocks without any too."""

    def make(key, t):
        counts, _ = kernels.n_mask(stream(t, "basecalls"), block)
        return {"chunk_id": [key[0]] * len(counts), "blk": list(range(len(counts))), "n_count": counts.tolist()}

    return by_chunk(reads.select("chunk_id", "rec", "basecalls"), ["chunk_id"], "chunk_id int, blk int, n_count int", make)


def n_positions(reads: DataFrame, block: int = N_BLOCK) -> DataFrame:
    """chunk_id, blk, pos, delta of each N."""

    def make(key, t):
        counts, deltas = kernels.n_mask(stream(t, "basecalls"), block)
        blk = np.repeat(np.arange(len(counts)), counts)
        total = np.cumsum(deltas)
        start = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(counts)))[:-1]]
        return {"chunk_id": [key[0]] * len(deltas), "blk": blk.tolist(), "pos": (total - start[blk]).tolist(), "delta": deltas.tolist()}

    return by_chunk(reads.select("chunk_id", "rec", "basecalls"), ["chunk_id"], "chunk_id int, blk int, pos int, delta int", make)


def bases_round_trip(reads: DataFrame, pack_order: str = "tgca") -> DataFrame:
    """rec and basecalls after packing, unpacking and putting N's back."""

    def make(key, t):
        s = stream(t, "basecalls")
        counts, deltas = kernels.n_mask(s)
        out = kernels.put_n(kernels.unpack(kernels.pack(s, pack_order), len(s), pack_order), counts, deltas).tobytes()
        parts = kernels.cut(out, np.array([len(x or "") for x in t["basecalls"].to_pylist()], np.int64))
        return {"chunk_id": [key[0]] * len(parts), "rec": t["rec"].to_pylist(), "basecalls": [p.decode() for p in parts]}

    return by_chunk(reads.select("chunk_id", "rec", "basecalls"), ["chunk_id"], "chunk_id int, rec long, basecalls string", make)


def transposed(reads: DataFrame) -> DataFrame:
    """chunk_id, n, width, stream: a fixed-length chunk's scores by cycle; other chunks have no row."""

    def make(key, t):
        q = t["quality"].to_pylist()
        width = len(q[0])
        if any(len(x) != width for x in q):
            return {"chunk_id": [], "n": [], "width": [], "stream": []}
        return {"chunk_id": [key[0]], "n": [len(q)], "width": [width], "stream": [kernels.transpose("".join(q).encode(), len(q), width)]}

    return by_chunk(reads.select("chunk_id", "rec", "quality"), ["chunk_id"], "chunk_id int, n long, width long, stream binary", make)


def untransposed(streams: DataFrame) -> DataFrame:
    """chunk_id, k, quality: the rows again, in order."""

    def run(batches):
        for b in batches:
            for c, n, w, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows = kernels.cut(kernels.untranspose(s, n, w), np.full(n, w))
                yield pa.record_batch({"chunk_id": pa.array([c] * n, pa.int32()), "k": pa.array(np.arange(n)), "quality": pa.array([r.decode() for r in rows])})

    return streams.mapInArrow(run, "chunk_id int, k long, quality string")
