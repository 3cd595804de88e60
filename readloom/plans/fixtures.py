"""Reads derived from the `events` table: one text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, LEAST, MOST = 4000, 50_000, 1_000_000

IDENTIFIER = "concat('SIM:', cast(1 + user_id % 4 as string), ':FC', cast(user_id % 3 as string), ':', cast(event_id % 8 + 1 as string), ':', cast(1000 + event_id % 1000 as string), ':', cast(event_id * 37 % 100003 as string), ' ', event_type)"
BASES = "translate(concat(md5(concat('s', cast(event_id as string))), md5(concat('t', cast(event_id as string)))), '0123456789abcdef', 'ACGTACGTACGTACGN')"
SCORES = "translate(concat(md5(concat('q', cast(event_id as string))), md5(concat('r', cast(event_id as string)))), '0123456789abcdef', 'FFFFFFFF::::,,#I')"
LENGTH = "cast(32 + event_id % 33 as int)"
PLUS = "case when event_id % 10 = 0 then 1 else 0 end"


def columns(fixed: bool = False, drift: bool = False) -> list[str]:
    cut = (lambda x: x) if fixed else (lambda x: f"substr({x}, 1, {LENGTH})")
    name = f"case when event_id = 150 then 'SIM_150' else {IDENTIFIER} end" if drift else IDENTIFIER
    return ["event_id as rec", f"cast(floor(event_id / {CHUNK}) as int) as chunk_id", f"{name} as identifier", f"{cut(BASES)} as basecalls", f"{PLUS} as plus_kind", f"{cut(SCORES)} as quality"]


def reads(spark: SparkSession, sf_dir: str, fixed: bool = False, drift: bool = False, ordered: bool = False) -> DataFrame:
    """ordered: by rec over all partitions; the events are sorted, with the columns in use only, and the reads derived after it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (in_order(events) if ordered else events).selectExpr(*columns(fixed, drift))


def in_order(events: DataFrame) -> DataFrame:
    """By event_id over all partitions: several a core, or more of LEAST to MOST rows.

    They are not left to Spark to merge by their bytes, as the reads of a partition are ten times as large.
    """
    rows = events.count()
    n = max(1, min(4 * events.sparkSession.sparkContext.defaultParallelism, rows // LEAST), -(-rows // MOST))
    return events.repartitionByRange(n, "event_id").sortWithinPartitions("event_id")


def cte(fixed: bool = False, drift: bool = False) -> str:
    """`reads as (...)` for DuckDB."""
    return f"reads as (select {', '.join(columns(fixed, drift))} from events)"


RAW = """raw as (select rec, chunk_id, concat('@', identifier) as l0, basecalls as l1,
  case when plus_kind = 1 then concat('+', identifier) else '+' end as l2, quality as l3 from reads)"""

FAULTS = {
    "l0": "case when rec % 1000 = 1 then '@' when rec % 1000 = 2 then substr(l0, 2) else l0 end",
    "l1": "case when rec % 1000 = 3 then concat('X', substr(l1, 2)) else l1 end",
    "l2": "case when rec % 1000 = 4 then '-' when rec % 1000 = 5 then '+other' else l2 end",
    "l3": "case when rec % 1000 = 6 then substr(l3, 2) else l3 end",
}
FAULTY = "faulty as (select rec, " + ", ".join(f"{x} as {k}" for k, x in FAULTS.items()) + " from raw)"


def faulty(raw: DataFrame) -> DataFrame:
    return raw.select("rec", *[F.expr(x).alias(k) for k, x in FAULTS.items()])
