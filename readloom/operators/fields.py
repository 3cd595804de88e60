"""Lines, field lengths and offsets, statistics, and the text of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plus_line() -> Column:
    return F.when(F.col("plus_kind") == 1, F.concat(F.lit("+"), F.col("identifier"))).otherwise(F.lit("+"))


def text() -> Column:
    """A record's four lines, without the last line break."""
    return F.concat(F.lit("@"), "identifier", F.lit("\n"), "basecalls", F.lit("\n"), plus_line(), F.lit("\n"), "quality")


def raw_lines(reads: DataFrame) -> DataFrame:
    return reads.select("rec", "chunk_id", F.concat(F.lit("@"), "identifier").alias("l0"), F.col("basecalls").alias("l1"), plus_line().alias("l2"), F.col("quality").alias("l3"))


def lines(raw: DataFrame) -> DataFrame:
    """A row a line: chunk_id, line (from 0 in the table), len (with the line break)."""
    each = raw.select("chunk_id", "rec", F.posexplode(F.array("l0", "l1", "l2", "l3")).alias("k", "value"))
    return each.select("chunk_id", (F.col("rec") * 4 + F.col("k")).alias("line"), (F.octet_length("value") + 1).cast("long").alias("len"))


def running(by: str = "line") -> Window:
    return Window.partitionBy("chunk_id").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def line_index(rows: DataFrame) -> DataFrame:
    """chunk_id, line, off: where each line starts in its chunk, and the chunk's size after its last line."""
    starts = rows.select("chunk_id", "line", (F.sum("len").over(running()) - F.col("len")).alias("off"))
    ends = rows.groupBy("chunk_id").agg((F.max("line") + 1).alias("line"), F.sum("len").alias("off"))
    return starts.unionByName(ends)


def offset_deltas(index: DataFrame) -> DataFrame:
    """The first offset, then differences: n + 1 values for n lines."""
    w = Window.partitionBy("chunk_id").orderBy("line")
    return index.select("chunk_id", "line", (F.col("off") - F.lag("off", 1, 0).over(w)).alias("delta"))


def offsets_restored(deltas: DataFrame) -> DataFrame:
    return deltas.select("chunk_id", "line", F.sum("delta").over(running()).alias("off"))


def prefix(reads: DataFrame, lengths: dict[str, Column]) -> DataFrame:
    """reads' rec and chunk_id, each length, and <name>_off: the sum of those before, over all chunks.

    Two levels: sums by chunk, their running sum (a row a chunk), and a window in each chunk.
    """
    rows = reads.select("chunk_id", "rec", *[c.cast("long").alias(k) for k, c in lengths.items()])
    sums = rows.groupBy("chunk_id").agg(*[F.sum(k).alias(f"{k}_sum") for k in lengths])
    every = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("chunk_id", *[F.coalesce(F.sum(f"{k}_sum").over(every), F.lit(0)).alias(f"{k}_start") for k in lengths])
    within = {f"{k}_off": F.sum(k).over(running("rec")) - F.col(k) for k in lengths}
    placed = rows.withColumns(within).join(starts, "chunk_id")
    return placed.select("rec", "chunk_id", *lengths, *[(F.col(f"{k}_off") + F.col(f"{k}_start")).alias(f"{k}_off") for k in lengths])


def field_offsets(reads: DataFrame) -> DataFrame:
    return prefix(reads, {"id_len": F.octet_length("identifier"), "seq_len": F.octet_length("basecalls"), "qual_len": F.octet_length("quality")})


def field_stats(reads: DataFrame) -> DataFrame:
    """Bytes of identifiers, basecalls, quality and of the line index (4 a line, and one)."""
    n = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long")
    return reads.agg(F.count("*").alias("records"), n("identifier").alias("identifier_bytes"), n("basecalls").alias("basecall_bytes"), n("quality").alias("quality_bytes"), ((F.count("*") * 4 + 1) * 4).alias("line_length_bytes"))


def quality_layout(reads: DataFrame) -> DataFrame:
    """A row a chunk: shortest and longest quality; fixed if they are one."""
    size = F.octet_length("quality")
    by = reads.groupBy("chunk_id").agg(F.count("*").alias("records"), F.min(size).alias("min_len"), F.max(size).alias("max_len"))
    fixed = F.col("min_len") == F.col("max_len")
    return by.select("*", F.when(fixed, "fixed").otherwise("variable").alias("layout"), F.when(fixed, F.col("min_len")).otherwise(0).alias("fixed_len"))


def n_totals(reads: DataFrame) -> DataFrame:
    n = F.octet_length("basecalls") - F.octet_length(F.translate("basecalls", "Nn", ""))
    return reads.groupBy("chunk_id").agg(F.sum(F.octet_length("basecalls")).alias("bases"), F.sum(n).cast("long").alias("n_bases"))


def naive_split(reads: DataFrame) -> DataFrame:
    """Bytes of the four lines by kind, with their markers and line breaks."""
    rows = raw_lines(reads)
    kinds = {"identifiers": "l0", "basecalls": "l1", "plus": "l2", "quality": "l3"}
    one = rows.agg(*[F.sum(F.octet_length(c) + 1).cast("long").alias(k) for k, c in kinds.items()])
    return one.select(F.expr("stack(4, " + ", ".join(f"'{k}', `{k}`" for k in kinds) + ") as (stream, raw_bytes)"))


def differences(a: DataFrame, b: DataFrame, key: tuple[str, ...] = ("rec", "identifier", "basecalls", "plus_kind", "quality")) -> DataFrame:
    """One row: records of a, of b, and rows that only one of them has."""
    x, y = (d.groupBy(*key).agg(F.count("*").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    both = x.join(y, list(key), "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(total(na).alias("records_in"), total(nb).alias("records_out"), total(F.abs(na - nb)).alias("differences"))
