"""Shards in Hilbert-curve order (method 8, native).

Each of several metadata dimensions (language, source, size, doc_id) is quantised to
2**BITS cells at its own quantiles; a Hilbert curve through the cells' grid gives each
row an index whose neighbours are near in every dimension. Rows are sorted by index and
cut into runs of equal length, so that a file covers a small box and min/max statistics
prune on any of the dimensions.

The curve is a table of moves (state, digit) -> (next state, rank), made from Gray-code
rotations, and looked up once a level: a plain expression. Order is a range exchange of
metadata only (index, hash of text, doc_id: ties of one index spread over tasks); ranks
are a row's place in its partition plus the rows of those before, one number a partition,
summed by a window over as many rows.
The ordered metadata are written to the shared folder once, so both uses see one order.

Law `rows`: shard = floor(rank * shards / rows); counts differ by one at most.

Edge cases: null dimensions are in the first cell; null text has 0 bytes and, like "",
the CRC 0; repeated rows each get a slot; an empty table gives no rows; columns other
than the dimensions and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common

BITS, SHARDS = 4, 8


def moves(n: int) -> list[int]:
    """For state * 2**n + digit: next state * 2**n + rank, in n dimensions. A state is an entry corner and a direction."""
    size, mask = 1 << n, (1 << n) - 1
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(size)}
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    ones = lambda x: ((x ^ (x + 1)).bit_length() - 1) % n  # trailing set bits
    out = []
    for state in range(size * n):
        corner, way = divmod(state, n)
        for digit in range(size):
            rank = place[turn(digit ^ corner, n - (way + 1) % n)]
            enter = gray((rank - 1) // 2 * 2) if rank else 0
            bend = 0 if not rank else ones(rank) if rank % 2 else ones(rank - 1)
            out.append(((corner ^ turn(enter, way + 1)) * n + (way + bend + 1) % n) * size + rank)
    return out


def index(cells: list[F.Column], bits: int = BITS) -> F.Column:
    """The place on the curve of cells of `bits` bits each."""
    n = len(cells)
    table = F.array(*[F.lit(x) for x in moves(n)])
    state, out = F.lit(0), F.lit(0)
    for level in reversed(range(bits)):
        digit = F.lit(0)
        for k, c in enumerate(cells):
            digit = digit.bitwiseOR(F.shiftleft(F.shiftright(c, level).bitwiseAND(1), k))
        move = F.get(table, F.shiftleft(state, n).bitwiseOR(digit))
        out = F.shiftleft(out, n).bitwiseOR(move.bitwiseAND((1 << n) - 1))
        state = F.shiftright(move, n)
    return out


def cut_points(df: DataFrame, names: list[str], bits: int = BITS) -> list[list]:
    """The quantiles of each column: of numbers from one pass of bounded sketches, of strings from their order.

    A value that many rows have is there several times, so that cells are shares of the rows:
    with distinct cut points a few frequent values would differ in a cell's lowest bits only.
    """
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    numbers = [c for c in names if c not in strings]
    row = df.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    return [string_cuts(df, c, at) if c in strings else list(row[c] or []) for c in names]


def string_cuts(df: DataFrame, name: str, at: list[float]) -> list[str]:
    """The values at these shares of the rows, nulls aside: distinct values in a range exchange, whole strings compared.

    What comes to the driver is a number a partition and at most a value a share.
    """
    spark, value = df.sparkSession, F.col(name)
    counts = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    order = common.keep(counts.repartitionByRange(common.parts(spark), "v").withColumn("p", F.spark_partition_id()), "values")
    start = starts(order.groupBy("p").agg(F.sum("n").alias("n")), "p")
    total = order.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    upto = order.join(start, "p").withColumn("to", F.col("__start") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    goals = [max(1, math.ceil(x * total)) for x in at]
    met = F.lit(False)
    for g in goals:
        met = met | ((F.col("to") >= g) & (F.col("to") - F.col("n") < g))
    found = upto.where(met).select("v", "n", "to").collect() if total else []
    return [r.v for g in goals for r in found if r.to - r.n < g <= r.to]


def starts(counts: DataFrame, key: str) -> DataFrame:
    """key, __start and __total from rows (key, n), one a partition: what is before, in order of key. Broadcast: 24 bytes a partition."""
    before, every = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return F.broadcast(counts.select(key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"), F.sum("n").over(every).alias("__total")))


def cell(c: F.Column, cuts: list) -> F.Column:
    """How many cut points are below the value."""
    out = F.lit(0)
    for x in cuts:
        out = out + F.coalesce(c > F.lit(x), F.lit(False)).cast("int")
    return out


def sharded(rows: DataFrame, dimensions: dict[str, F.Column], tie: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows, and shard, slot, curve. dimensions: name -> long or string column."""
    spark, names = rows.sparkSession, [f"__d_{k}" for k in dimensions]
    read = common.keep(rows.withColumns(dict(zip(names, dimensions.values(), strict=True))), "metadata")
    cells = [cell(F.col(n), cuts) for n, cuts in zip(names, cut_points(read, names, bits), strict=True)]
    placed = read.withColumn("curve", index(cells, bits)).drop(*names)
    order = ["curve", *tie]
    ordered = common.keep(placed.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = starts(ordered.groupBy(part.alias("__p")).agg(F.count("*").alias("n")), "__p")
    ranked = ordered.join(before, part == F.col("__p")).withColumn("__rank", F.col("__start") + within)
    ranked = ranked.withColumn("shard", F.expr(f"__rank * {shards} div __total").cast("int"))
    return ranked.withColumn("slot", F.col("__rank") - F.expr(f"(shard * __total + {shards - 1}) div {shards}")).drop("__p", "__start", "__total", "__at", "__rank")


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of each row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__h"))
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size"), "doc_id": F.col("doc_id").cast("long")}
    out = sharded(light, dims, ["__h", "doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8(spark, sf_dir: str) -> DataFrame:
    return document_shards(common.table(spark, sf_dir, "documents"))
