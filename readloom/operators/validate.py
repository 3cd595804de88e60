"""Rules for records, as columns: the first rule that a record breaks, or null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UINT32_MAX

#: Lines of a record: l0 identifier, l1 basecalls, l2 plus, l3 quality.
LINES = ("l0", "l1", "l2", "l3")

MESSAGES = {
    "V7": "a record's first line must start with '@'",
    "V8": "a record's third line must start with '+'",
    "V9": "the identifier is empty",
    "V10": "the plus line is neither bare nor '+' and the identifier",
    "V11": "sequence and quality differ in length",
    "V14": "a line is longer than 4294967295 bytes",
    "V15": "a basecall is none of A C G T N",
}


def error(l0: Column, l1: Column, l2: Column, l3: Column, longest: int = UINT32_MAX) -> Column:
    """The rule that the record breaks first, in the order in which a parser meets them."""
    long = F.greatest(*[F.octet_length(x) for x in (l0, l1, l2, l3)]) > F.lit(longest)
    return (
        F.when(~l0.startswith("@"), "V7")
        .when(~l2.startswith("+"), "V8")
        .when(F.octet_length(l0) == 1, "V9")
        .when((l2 != "+") & (F.substring(l2, 2, 2147483647) != F.substring(l0, 2, 2147483647)), "V10")
        .when(F.octet_length(l1) != F.octet_length(l3), "V11")
        .when(long, "V14")
        .when(l1.rlike("[^ACGTNacgtn]"), "V15")
    )


def checked(lines: DataFrame, longest: int = UINT32_MAX) -> DataFrame:
    """lines (rec, l0..l3) and error."""
    return lines.withColumn("error", error(*[F.col(c) for c in LINES], longest))


def parsed(lines: DataFrame, mode: str = "strict", also: tuple[str, ...] = ()) -> DataFrame:
    """rec, identifier, basecalls, plus_kind, quality, and the columns named in `also`.

    strict: the first bad record fails the job. permissive: bad records go; rejected() has them.
    """
    rows = checked(lines)
    if mode == "strict":
        text = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("error"))
        ok = F.when(F.col("error").isNull(), F.col("l0")).otherwise(F.raise_error(F.concat(F.lit("record "), (F.col("rec") + 1).cast("string"), F.lit(": "), text)).cast("string"))
        rows = rows.withColumn("l0", ok)
    elif mode == "permissive":
        rows = rows.where("error is null")
    else:
        raise ValueError("mode is strict or permissive")
    plus = F.when(F.col("l2") == "+", 0).otherwise(1)
    return rows.select("rec", F.substring("l0", 2, 2147483647).alias("identifier"), F.col("l1").alias("basecalls"), plus.alias("plus_kind"), F.col("l3").alias("quality"), *also)


def rejected(lines: DataFrame) -> DataFrame:
    return checked(lines).where("error is not null").select("rec", "error", *LINES)


def check_index(offsets: np.ndarray, size: int, records: int, last_byte: bytes = b"\n") -> str | None:
    """The rule on a whole line index that is broken (V1-V6, V13), or None. The decoder calls it for each chunk."""
    offsets = np.asarray(offsets, np.int64)
    if size == 0:
        return None if offsets.tolist() == [0] and records == 0 else "V1"
    if last_byte != b"\n":
        return "V2"
    if not len(offsets) or offsets[0] != 0:
        return "V3"
    if offsets[-1] != size:
        return "V4"
    if (len(offsets) - 1) % 4:
        return "V5"
    if (len(offsets) - 1) // 4 != records:
        return "V6"
    return "V13" if (np.diff(offsets) <= 0).any() else None


def check_records(offsets: np.ndarray, lengths: np.ndarray) -> str | None:
    """V12: lines, of these lengths without their ends, that don't follow one another in the index. lengths: a row a record."""
    return "V12" if (np.diff(offsets) != np.ravel(lengths) + 1).any() else None


def index_errors(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id and the first rule that a chunk's line index breaks. index: chunk_id, line, off; chunks: chunk_id, size, records.

    An index has the offsets of all lines and, last, the chunk's size. Steps between lines are
    taken from a window in the chunk, which is bounded.
    """
    step = F.col("off") - F.lag("off").over(Window.partitionBy("chunk_id").orderBy("line"))
    by = index.withColumn("step", step).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min_by("off", "line").alias("first"), F.max_by("off", "line").alias("last"), F.min("step").alias("least"))
    n = F.coalesce("n", F.lit(0))
    rule = (
        F.when((F.col("size") == 0) & ((n != 1) | (F.col("first") != 0) | (F.col("records") != 0)), "V1")
        .when(F.col("size") == 0, None)
        .when((n == 0) | (F.col("first") != 0), "V3")
        .when(F.col("last") != F.col("size"), "V4")
        .when((n - 1) % 4 != 0, "V5")
        .when(F.floor((n - 1) / 4) != F.col("records"), "V6")
        .when(F.col("least") <= 0, "V13")
    )
    return chunks.join(by, "chunk_id", "left").select("chunk_id", rule.alias("error")).where("error is not null")
