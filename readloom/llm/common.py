"""What the operators of this folder share: tables, shared storage, text hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Cuts lineage: a lost executor costs no more than what is read from there,
    and two uses of the result see the same rows.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a plain expression: no Python and no RDD when it is read."""
    kind = StructType.fromDDL(schema)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind.fields, strict=True)]) for r in rows]
    every = F.array(*structs) if rows else F.array().cast(f"array<struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in kind.fields)}>>")
    return spark.range(1).select(F.inline(every))


class HashOf(dict):
    """word -> 64-bit hash, remembered. clear_if_large() bounds the memory; no result depends on it."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def array(self, words: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (murmur3): every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: An odd multiplier for hashes of word sequences.
STEP = 0x9E3779B97F4A7C15


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive word hashes (none if there are fewer)."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(STEP)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)
