"""The container: a folder with streams (Parquet, by chunk) and meta (one row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import Options, options_json
from ..functions import codecs
from ..schema import ALWAYS, COLUMN_ENCODINGS, COLUMN_KINDS, MAGIC, N_BLOCK, QUALITY_LAYOUTS, STREAMS, VERSION, VERSIONS


def write(streams: DataFrame, path: str, options: Options | None = None) -> None:
    spark = streams.sparkSession
    streams.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/streams")
    spark.range(1).select(F.lit(MAGIC).cast("long").alias("magic"), F.lit(VERSION).alias("version"), F.lit(options_json(options or Options())).alias("options")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read(spark: SparkSession, path: str) -> DataFrame:
    """STREAMS; fails on another magic number or an unknown version."""
    head = spark.read.schema("magic long, version int, options string").json(f"{path}/meta").first()
    if head is None or head.magic != MAGIC:
        raise ValueError("not a container")
    if head.version not in VERSIONS:
        raise ValueError(f"container version {head.version} is not supported")
    return spark.read.schema(STREAMS).parquet(f"{path}/streams")


def first_chunk(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path)
    least = rows.agg(F.min("chunk_id")).first()[0]
    if least is None:
        raise ValueError("the container has no chunk")
    return rows.where(F.col("chunk_id") == least)


def violations(streams: DataFrame) -> DataFrame:
    """Rows (chunk_id, rule) for streams that do not fit one another; empty if all is well."""
    whole = streams.groupBy("chunk_id", "stream", "col").agg(
        F.max("n").alias("n"), F.sum("raw_bytes").alias("raw"), F.max((F.col("kind") == "string") & (F.col("encoding") != "plain")).alias("odd"),
        F.count("*").alias("slices"), F.max("slice").alias("last"), F.count_if(~F.col("codec").isin(*codecs.NAMES)).alias("odd_codec"), F.count_if(~F.col("encoding").isin(*COLUMN_ENCODINGS)).alias("odd_encoding"), F.count_if((F.col("stream") == "id_values") & ~F.col("kind").isin(*COLUMN_KINDS)).alias("odd_kind"),
        F.first(F.when(F.col("stream") == "about", F.from_json(F.col("payload").cast("string"), "layout string, columnar boolean, separators array<string>")), True).alias("about"),
        F.count_if(F.col("payload").isNull() | (F.octet_length("payload") != F.col("comp_bytes")) | ((F.col("raw_bytes") > 0) != (F.col("comp_bytes") > 0))).alias("broken"),
    )
    of = lambda s, c: F.coalesce(F.max(F.when(F.col("stream") == s, F.col(c))), F.lit(0))
    by = whole.groupBy("chunk_id").agg(
        of("bases", "n").alias("bases"), of("bases", "raw").alias("packed"), of("n_counts", "raw").alias("counts"), of("n_positions", "raw").alias("positions"), of("n_positions", "n").alias("ns"),
        of("plus", "n").alias("records"), of("plus", "raw").alias("plus"), of("line_lengths", "n").alias("lines"), of("line_lengths", "raw").alias("line_bytes"), of("quality", "n").alias("scores"), of("quality", "raw").alias("quality"),
        F.first("about", True).alias("about"), F.count_if(F.col("last") + 1 != F.col("slices")).alias("gaps"), F.sum("odd_codec").alias("odd_codec"), F.sum("odd_encoding").alias("odd_encoding"), F.sum("odd_kind").alias("odd_kind"),
        F.count_if(F.col("stream") == "id_values").alias("columns"), F.count_if(F.col("stream") == "id_flat").alias("flat"), F.count_if(F.col("stream").isin(*ALWAYS)).alias("always"),
        F.sum("broken").alias("broken"), F.count_if((F.col("stream") == "id_values") & F.col("odd")).alias("bad_encoding"), F.count_if((F.col("stream") == "id_lengths") & (F.col("raw") != 4 * F.col("n"))).alias("bad_lengths"),
    )
    columns = F.when(F.col("about.columnar"), F.size("about.separators") + 1).otherwise(0)
    rules = {
        "missing streams": F.col("always") != len(ALWAYS),
        "slice numbers": F.col("gaps") > 0,
        "codec names": F.col("odd_codec") > 0,
        "column kinds": F.col("odd_kind") > 0,
        "column encodings": F.col("odd_encoding") > 0,
        "layout names": ~F.col("about.layout").isin(*QUALITY_LAYOUTS),
        "columns and separators": (F.col("columns") != columns) | (F.col("flat") != F.when(F.col("about.columnar"), 0).otherwise(1)),
        "stream sizes": F.col("broken") > 0,
        "string column encoding": F.col("bad_encoding") > 0,
        "string column lengths": F.col("bad_lengths") > 0,
        "packed size": F.col("packed") != F.ceil(F.col("bases") / 4),
        "n counts size": F.col("counts") != 2 * F.ceil(F.col("bases") / N_BLOCK),
        "n positions size": F.col("positions") != 2 * F.col("ns"),
        "plus kinds": F.col("plus") != F.col("records"),
        "line lengths": (F.col("line_bytes") != 4 * F.col("lines")) | (F.col("lines") != 4 * F.col("records") + 1),
        "quality size": F.col("quality") != F.col("scores"),
    }
    broken = F.array_compact(F.array(*[F.when(bad | bad.isNull(), F.lit(k)) for k, bad in rules.items()]))
    return by.select("chunk_id", F.explode(broken).alias("rule"))
