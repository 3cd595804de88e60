"""Four-line sequencing files as a Spark data source.

A file is cut into byte ranges; a record belongs to the range that holds its first byte.
Records are lines 4k to 4k+3 of a file and nothing else decides where one begins: a first
pass counts the line breaks of each range (a row a range, summed in order on the driver), so
that each range knows the number of its first line. What is malformed is therefore one and
the same record however the file is cut, and no byte is passed over. Files whose last line
has no end (V2) or whose lines are no multiple of four (V5) fail before anything is read.

A task takes a run of ranges that follow one another, so that small ranges make no more tasks
than large ones; the first pass has a row a run. Ranges are read in blocks, no further than
their last record: numpy finds the line breaks and Arrow takes the lines from the block by
their places, without a Python object a line.

Paths are opened by pyarrow's file systems (local, hdfs, s3 ...). For stores that only
Spark's readers reach, lines_of() reads the lines with Spark's text source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import fields, validate
from ..storage import shared_dir

PARTITION_BYTES, BLOCK, TAIL, BATCH, CHUNK_BYTES = 64 << 20, 4 << 20, 4 << 10, 8192, 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in order of name."""
    fs, top = opened(path)
    info = fs.get_file_info(top)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(top, recursive=True))
    keep = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f.path, f.size) for f in keep)


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file; lines: the file's line breaks before start; rec, chunk: the file's first record and chunk."""

    file: str
    number: int
    start: int
    end: int
    size: int
    lines: int = 0
    rec: int = 0
    chunk: int = 0


def ranges(path: str, step: int) -> list[Range]:
    return [Range(f, k, a, min(n, a + step), n) for k, (f, n) in enumerate(files(path)) for a in range(0, n, step)]


def run_bytes(path: str, step: int, tasks: int) -> int:
    """Bytes of a task's run: whole ranges, of PARTITION_BYTES at most, fewer where there would not be `tasks` runs."""
    n = sum(-(-size // step) for _, size in files(path))
    return step * max(1, min(PARTITION_BYTES // step, -(-n // tasks)))


def breaks(raw, p: Range) -> tuple[int, bytes]:
    """Line breaks in a range, and its last byte."""
    raw.seek(p.start)
    n, last, left = 0, b"", p.end - p.start
    while left and (block := raw.read(min(left, BLOCK))):
        n, last, left = n + block.count(b"\n"), block[-1:], left - len(block)
    return n, last


def records(raw, p: Range) -> Iterator[tuple[bytes, int, np.ndarray, int, int]]:
    """Whole records that start in a range: (bytes, their place in the file, ends of lines in them, start of the first, its number in the file)."""
    base = max(0, p.start - 1)
    raw.seek(base)
    held, line = b"", None if p.start else 0
    while True:
        block = raw.read(min(BLOCK, max(0, p.end - base - len(held)) + max(TAIL, len(held))))
        data, begin = held + block, 0
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if line is None and len(ends):  # the line that runs into the range belongs to the one before
            begin, line, ends = int(ends[0]) + 1, p.lines + int(ends[0] > 0), ends[1:]
        if line is not None and line % 4:  # and so does the record
            k = min(-line % 4, len(ends))
            begin, line, ends = int(ends[k - 1]) + 1 if k else begin, line + k, ends[k:]
        if line is not None and line % 4 == 0:
            n = len(ends) // 4
            starts = base + np.concatenate(([begin], ends[3 : 4 * n : 4] + 1))
            here = int(np.searchsorted(starts[:n], p.end))
            if here:
                yield data, base, ends[: 4 * here], begin, line // 4
            if starts[here] >= p.end:
                return
            begin, line = int(starts[n] - base), line + 4 * n
        elif base + len(data) >= p.end:  # no record starts in the range
            return
        if not block:
            return
        held, base = data[begin:], base + begin


class Reader(DataSourceReader):
    def __init__(self, options: dict, binary: bool, count: bool) -> None:
        self.path, self.binary, self.count = options["path"], binary, count
        self.step = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.run = int(options.get("run", self.step))
        self.starts = options.get("starts", "")

    def partitions(self):
        every = ranges(self.path, self.run)
        if self.starts:
            fs, path = opened(self.starts)
            with fs.open_input_file(path) as f:
                known = np.frombuffer(f.read(), "<i8").reshape(-1, 3).tolist()
            for p, (p.lines, p.rec, p.chunk) in zip(every, known, strict=True):
                pass
        return every or [Range("", 0, 0, 0, 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if not p.file:
            return
        with opened(self.path)[0].open_input_file(p.file) as raw:
            if self.count:
                yield self.counted(raw, p)
                return
            lines = p.lines
            for a in range(p.start, p.end, self.step):
                r = replace(p, start=a, end=min(p.end, a + self.step), lines=lines)
                for data, base, ends, begin, first in records(raw, r):
                    yield from self.batches(r, data, base, ends, begin, first)
                if r.end < p.end:
                    lines += breaks(raw, r)[0]

    def counted(self, raw, p: Range) -> pa.RecordBatch:
        n, last = breaks(raw, p)
        return pa.record_batch([pa.array([p.number], pa.int32()), pa.array([p.start], pa.int64()), pa.array([n], pa.int64()), pa.array([last == b"\n"])], names=[c.split()[0] for c in COUNTS.split(", ")])

    def batches(self, p: Range, data: bytes, base: int, ends: np.ndarray, begin: int, first: int) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate(([begin], ends + 1)).astype(np.int32)
        lines = pc.binary_slice(pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(data)]), 0, -1)
        kind = pa.binary() if self.binary else pa.string()
        text = [lines.take(pa.array(np.arange(k, len(ends), 4))).cast(kind) for k in range(4)]
        at = edges[::4].astype(np.int64)
        n = len(at) - 1
        same = lambda v, t: pa.repeat(pa.scalar(v, t), n)
        columns = [same(p.file, pa.string()), same(p.number, pa.int32()), pa.array(p.rec + first + np.arange(n)), pa.array(base + at[:-1]), pa.array(np.diff(at)), same(p.size, pa.int64()), same(p.chunk, pa.int64()), *text]
        whole = pa.record_batch(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])
        for k in range(0, n, BATCH):
            yield whole.slice(k, BATCH)


SCHEMA = "file string, file_no int, rec long, off long, bytes long, file_bytes long, first_chunk long, l0 string, l1 string, l2 string, l3 string"
COUNTS = "file_no int, range_start long, lines long, ended boolean"


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path); options partitionBytes, run (bytes of a task's ranges), binary (lines as bytes: any encoding), count (lines of runs), starts (what scan() makes of these)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def schema(self) -> str:
        if self.flag("count"):
            return COUNTS
        return SCHEMA.replace("l0 string, l1 string, l2 string, l3 string", "l0 binary, l1 binary, l2 binary, l3 binary") if self.flag("binary") else SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options, self.flag("binary"), self.flag("count"))


def starts(spark: SparkSession, path: str, run: int, chunk_bytes: int) -> str:
    """A file of (lines before, first record and chunk of the file) for each run, from counts of lines; V2 and V5 fail."""
    rows = spark.read.format("fastq").option("run", run).option("count", "true").load(path).collect()  # a row a run
    counted = {(r.file_no, r.range_start): r for r in rows}
    out, before, rec, chunk = [], 0, 0, 0
    for p in ranges(path, run):
        if not p.start:
            before = 0
        c = counted[p.number, p.start]
        out.append((before, rec, chunk))
        before += c.lines
        if p.end == p.size:
            if not c.ended:
                raise ValueError(f"V2: {p.file} does not end with a line break (byte {p.size})")
            if before % 4:
                raise ValueError(f"V5: the number of lines of {p.file}, {before}, is not a multiple of 4")
            rec, chunk = rec + before // 4, chunk + -(-p.size // chunk_bytes)
    target = shared_dir(spark, "starts")
    fs, to = opened(target)
    fs.create_dir(to.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(to) as f:
        f.write(np.array(out, "<i8").tobytes())
    return target


def scan(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES, binary: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """SCHEMA: a row a record, unordered; rec is its number over all files, in order of name."""
    spark.dataSource.register(FastqSource)
    run = run_bytes(path, partition_bytes, 2 * spark.sparkContext.defaultParallelism)
    known = starts(spark, path, run, chunk_bytes)
    return spark.read.format("fastq").option("partitionBytes", partition_bytes).option("run", run).option("binary", str(binary).lower()).option("starts", known).load(path)


def read(spark: SparkSession, path: str, mode: str = "strict", chunk_bytes: int = CHUNK_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Reads of a file or folder: rec, chunk_id, off, identifier, basecalls, plus_kind, quality, file.

    A chunk is a run of chunk_bytes of a file; chunks are numbered over all files.
    mode: strict fails at a bad record, permissive leaves it out.
    """
    rows = scan(spark, path, partition_bytes, chunk_bytes=chunk_bytes)
    rows = rows.withColumn("chunk_id", (F.col("first_chunk") + F.floor(F.col("off") / chunk_bytes)).cast("int"))
    return validate.parsed(rows, mode, ("chunk_id", "off", "file"))


def uncovered(rows: DataFrame) -> DataFrame:
    """Files whose records do not add up to their bytes; empty if all is read."""
    return rows.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("file_bytes").alias("file_bytes")).where("bytes <> file_bytes")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines by Spark's own text reader: file, off (place of the split), value. For stores that only Spark reads."""
    return spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")


def write(reads: DataFrame, path: str, ordered: bool = False) -> None:
    """Text files that, in order of name, hold the records in order of rec.

    Sorting makes the reads twice, for the borders of its partitions and for the rows, and exchanges
    their texts. ordered: they are in order of rec over all partitions already, and are made once.
    """
    (reads if ordered else reads.orderBy("rec")).select(fields.text()).write.text(path)
