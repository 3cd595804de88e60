"""Compress, decompress, round trip and the comparison of codecs, end to end."""

from __future__ import annotations

import time

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import chunks, encode, fields
from ..operators.chunks import Options
from ..schema import OWN, STREAMS
from ..sources import container, fastq


def compress(spark: SparkSession, source: str, target: str, options: Options | None = None, mode: str = "strict", chunk_bytes: int = 8 << 20) -> dict:
    """Totals, bytes of the file and of the container, and seconds: index (lines counted), encode (scan, validate, encode, write in one job), report."""
    stage, began = {}, time.time()

    def done(name: str) -> None:
        stage[f"{name}_seconds"] = time.time() - began - sum(stage.values())

    reads = fastq.read(spark, source, mode, chunk_bytes)
    done("index")
    container.write(chunks.encoded(reads, options), target, options)
    done("encode")
    size = lambda path: sum(n for _, n in fastq.files(path))
    got = totals(container.read(spark, target)).first().asDict() | {"file_bytes": size(source), "container_bytes": size(target)}
    done("report")
    return got | stage | {"file_percent": 100 * got["container_bytes"] / got["file_bytes"] if got["file_bytes"] else None, "seconds": sum(stage.values())}


def decompress(spark: SparkSession, source: str, target: str) -> None:
    fastq.write(chunks.decoded(container.read(spark, source)), target)


def roundtrip(spark: SparkSession, source: str, folder: str, options: Options | None = None) -> dict:
    """Records in and out, and rows that differ, after compressing into `folder` and back."""
    compress(spark, source, folder, options)
    back = chunks.decoded(container.read(spark, folder))
    return fields.differences(fastq.read(spark, source), back).first().asDict()


def totals(streams: DataFrame) -> DataFrame:
    """One row: records, raw bytes (identifiers, basecalls, quality and line index of the records) and compressed bytes (without plus kinds), ratio in percent."""
    payload = ~F.col("stream").isin("plus", *OWN)
    n = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("long")
    one = streams.agg(n("n", (F.col("stream") == "plus") & (F.col("slice") == 0)).alias("records"), n("text_bytes", F.lit(True)).alias("raw_bytes"), n("comp_bytes", payload).alias("comp_bytes"))
    return one.withColumn("payload_percent", codecs.ratio_percent(F.col("comp_bytes"), F.col("raw_bytes")))


def by_stream(streams: DataFrame) -> DataFrame:
    """A row a stream, an identifier column's values and lengths as one: kind, encodings used, raw and encoded and compressed bytes, percent of raw.

    raw: text of the records; for lengths of string columns, N counts and positions, plus kinds and what is the container's own, their plain size.
    """
    plain = F.col("stream").isin("id_lengths", "n_counts", "n_positions", "plus", *OWN)
    name = F.when(F.col("stream").isin("id_values", "id_lengths"), "id_column").otherwise(F.col("stream"))
    by = streams.groupBy(name.alias("stream"), "col").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("stream") == "id_values", F.col("kind")))), ",").alias("kind"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("stream") != "id_lengths", F.col("encoding")))), ",").alias("encoding"), F.sum(F.when(plain, F.col("raw_bytes")).otherwise(F.col("text_bytes"))).alias("raw_bytes"), F.sum("raw_bytes").alias("encoded_bytes"), F.sum("comp_bytes").alias("comp_bytes"))
    return by.withColumn("percent", codecs.ratio_percent(F.col("comp_bytes"), F.col("raw_bytes")))


CASES = "variant string, codec string, stream string, raw_bytes long, comp_bytes long, micros long"


def ablation(reads: DataFrame, codecs_: tuple[str, ...] = ("bwt", "zstd")) -> DataFrame:
    """variant, codec, stream, raw_bytes, comp_bytes, percent, seconds: the records' text as it is, its four lines apart, and all encodings, also with transposed scores.

    raw_bytes of the whole is the text's; a percentage is of that. seconds: of the codec, summed
    over chunks; null for all encodings. The reads are exchanged once: a chunk's task makes all cases.
    """
    full = {("full_transposed" if turned else "full", c): Options(quality_codec=c, transpose=turned) for c in codecs_ for turned in ((False, True) if c == "zstd" else (False,))}

    def make(key, t):
        def text(*parts) -> bytes:
            return encode.stream(pa.table({"v": pc.binary_join_element_wise(*parts, "")}), "v")

        marked = pc.fill_null(pc.equal(t["plus_kind"], 1), False)
        l0, l1, l3 = pc.binary_join_element_wise("@", t["identifier"], "\n", ""), pc.binary_join_element_wise(t["basecalls"], "\n", ""), pc.binary_join_element_wise(t["quality"], "\n", "")
        l2 = pc.if_else(marked, pc.binary_join_element_wise("+", t["identifier"], "\n", ""), "+\n")
        whole, lines = text(l0, l1, l2, l3), {"identifiers": text(l0), "basecalls": text(l1), "plus": text(l2), "quality": text(l3)}
        rows = []

        def plain(variant: str, codec: str, stream: str, data: bytes) -> tuple:
            began = time.perf_counter()
            size = sum(len(codecs.compress(p, codec)) for p in codecs.slices(data))
            rows.append((variant, codec, stream, len(data), size, int(1e6 * (time.perf_counter() - began))))
            return rows[-1][3:]

        for c in codecs_:
            plain("raw", c, "all", whole)
            rows.append(("split", c, "all", *map(sum, zip(*[plain("split", c, k, x) for k, x in lines.items()], strict=True))))
        size = encode.arrow(STREAMS).get_field_index("comp_bytes")
        for (variant, c), streams in zip(full, chunks.coded(key[0], t, tuple(full.values())), strict=True):
            rows.append((variant, c, "all", len(whole), sum(r[size] for r in streams), None))
        return dict(zip(encode.arrow(CASES).names, zip(*rows, strict=True), strict=True))

    every = encode.by_chunk(reads.select(*chunks.READ_IN), ["chunk_id"], CASES, make)
    none = reads.sparkSession.createDataFrame([(v, c, "all", None, None, None) for v, c in full], CASES)  # without reads too, all encodings have a row
    by = every.unionByName(none).groupBy("variant", "codec", "stream").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("comp_bytes").alias("comp_bytes"), (F.sum("micros") / 1e6).alias("seconds"))
    return by.withColumn("percent", codecs.ratio_percent(F.col("comp_bytes"), F.col("raw_bytes")))
