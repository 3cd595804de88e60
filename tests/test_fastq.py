import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from readloom import cli
from readloom.functions import codecs
from readloom.operators import chunks, fields, identifiers, validate
from readloom.operators.chunks import Options
from readloom.plans import fixtures, workflow
from readloom.sources import binary, container, fastq


def record(i, seq="ACGTN", qual=None, plus="+"):
    return f"@R:{i}:x {i * 3}\n{seq}\n{plus}\n{qual or 'I' * len(seq)}\n"


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.select("rec", "identifier", "basecalls", "plus_kind", "quality").orderBy("rec").collect()]


def test_many_tiny_ranges_lose_and_repeat_nothing(spark, tmp_path):
    text = "".join(record(i, "ACGT" * (i % 7), ("@+I@" * (i % 7))) for i in range(400))
    path = put(tmp_path / "a.fq", text)
    whole = rows(fastq.read(spark, path))
    assert len(whole) == 400 and [r[0] for r in whole] == list(range(400))
    for step in (17, 64, 1000):
        assert rows(fastq.read(spark, path, partition_bytes=step)) == whole
        assert fastq.uncovered(fastq.scan(spark, path, step)).count() == 0


def test_several_files_are_in_order_of_name(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    put(d / "b.fq", record(2))
    put(d / "a.fq", record(0) + record(1))
    put(d / "_SUCCESS", "")
    got = fastq.read(spark, str(d))
    assert [r[1] for r in rows(got)] == ["R:0:x 0", "R:1:x 3", "R:2:x 6"]
    assert got.select("chunk_id").distinct().count() == 2


def test_empty_file(spark, tmp_path):
    assert rows(fastq.read(spark, put(tmp_path / "e.fq", ""))) == []
    assert validate.check_index([0], 0, 0, b"") is None
    assert validate.check_index([0, 1], 0, 0, b"") == "V1"


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        (record(0)[:-1], "V2"),
        (record(0) + "\n", "V5"),
        (record(0)[1:], "record 1"),
        (record(0, plus="-"), "record 1"),
        ("@\nA\n+\nI\n", "identifier is empty"),
        (record(0, plus="+other"), "plus line"),
        (record(0, "ACGT", "III"), "differ in length"),
        (record(0, "ACXT"), "none of A C G T N"),
        (record(0).replace("\n", "\r\n"), "plus line"),
    ],
)
def test_strict_mode_fails_at_each_rule(spark, tmp_path, text, rule):
    with pytest.raises(Exception, match=rule):
        fastq.read(spark, put(tmp_path / "x.fq", text)).collect()


def test_permissive_mode_keeps_the_good_and_shows_the_rest(spark, tmp_path):
    path = put(tmp_path / "x.fq", record(0) + record(1, "AXC") + record(2))
    assert [r[0] for r in rows(fastq.read(spark, path, "permissive"))] == [0, 2]
    raw = fastq.scan(spark, path)
    assert [(r.rec, r.error) for r in validate.rejected(raw).collect()] == [(1, "V15")]
    with pytest.raises(ValueError):
        validate.parsed(raw, "lenient")


FAULTS = {
    "V7": lambda r: r[1:],
    "V8": lambda r: r.replace("\n+\n", "\n-\n"),
    "V9": lambda r: "@\n" + r.partition("\n")[2],
    "V10": lambda r: r.replace("\n+\n", "\n+other\n"),
    "V11": lambda r: r[:-2] + "\n",
    "V15": lambda r: r.replace("ACGTN", "ACGTX", 1),
}


@pytest.mark.parametrize("rule", FAULTS)
def test_a_bad_record_is_found_wherever_the_file_is_cut(spark, tmp_path, rule, monkeypatch):
    parts = [record(i, qual="@+I@+") for i in range(5)]
    parts[2] = FAULTS[rule](parts[2])
    path = put(tmp_path / "x.fq", "".join(parts))
    size, want = len("".join(parts)), [r.encode().split(b"\n")[:4] for r in parts]
    first = fastq.ranges(path, size)[0]
    for cut in range(1, size):  # every cut, without Spark: counts, then both ranges
        monkeypatch.setattr(fastq, "BLOCK", 1 + cut % 13)
        reader, got = fastq.Reader({"path": path, "partitionBytes": str(cut)}, True, False), []
        lines = 0
        for p in fastq.ranges(path, cut)[:2] if 2 * cut >= size else [fastq.Range(first.file, 0, 0, cut, size), fastq.Range(first.file, 0, cut, size, size)]:
            p.lines = lines
            with open(path, "rb") as raw:
                lines += reader.counted(raw, p).column(2)[0].as_py()
            for b in reader.read(p):
                got += [(r["rec"], [r[f"l{k}"] for k in range(4)]) for r in b.to_pylist()]
        assert got == list(enumerate(want)) and lines == 20
    for step in (7, size // 2 + 3, size):
        raw = fastq.scan(spark, path, step)
        assert [(r.rec, r.error) for r in validate.rejected(raw).collect()] == [(2, rule)]
        assert [r[0] for r in rows(fastq.read(spark, path, "permissive", partition_bytes=step))] == [0, 1, 3, 4]
        with pytest.raises(Exception, match="record 3"):
            fastq.read(spark, path, partition_bytes=step).collect()


def test_long_records_and_several_blocks(spark, tmp_path, monkeypatch):
    text = "".join(record(i, "ACGTN" * (200 * (i % 5))) for i in range(60))
    path = put(tmp_path / "l.fq", text)
    monkeypatch.setattr(fastq, "BLOCK", 100)
    p, got = fastq.ranges(path, len(text))[0], []
    for b in fastq.Reader({"path": path}, False, False).read(p):
        got += b.to_pylist()
    assert "".join(f"{r['l0']}\n{r['l1']}\n{r['l2']}\n{r['l3']}\n" for r in got) == text and sum(r["bytes"] for r in got) == len(text)


def test_small_ranges_make_no_more_tasks_than_large_ones(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    put(d / "a.fq", "".join(record(i) for i in range(3000)))
    put(d / "b.fq", "".join(record(i)[i == 3007 :] for i in range(3000, 3100)))
    raw = fastq.scan(spark, str(d), 50)  # about 1,700 ranges
    assert raw.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 2
    assert sorted(r.rec for r in raw.collect()) == list(range(3100)) and fastq.uncovered(raw).count() == 0
    assert [(r.rec, r.error) for r in validate.rejected(raw).collect()] == [(3007, "V7")]


def test_a_range_is_not_read_beyond_its_last_record(tmp_path):
    class Counted:
        def __init__(self, raw):
            self.raw, self.seek, self.bytes = raw, raw.seek, 0

        def read(self, n):
            out = self.raw.read(n)
            self.bytes += len(out)
            return out

    for text, step in (("".join(record(i) for i in range(20000)), 1 << 15), (record(0, "ACGT" * 200000) + record(1), 1 << 12)):
        path = put(tmp_path / "r.fq", text)
        lines, got = 0, []
        with open(path, "rb") as f:
            raw = Counted(f)
            for p in fastq.ranges(path, step):
                p.lines = lines
                lines += text[p.start : p.end].count("\n")
                got += [data[begin : ends[-1] + 1] for data, _, ends, begin, _ in fastq.records(raw, p)]
        assert b"".join(got).decode() == text and raw.bytes < 3 * len(text)


def test_lines_beyond_the_limit(spark):
    raw = spark.createDataFrame([(0, "@a", "ACGT", "+", "IIII"), (1, "@a", "ACGTA", "+", "IIIII")], "rec long, l0 string, l1 string, l2 string, l3 string")
    assert [(r.rec, r.error) for r in validate.checked(raw, 4).collect()] == [(0, None), (1, "V14")]


def test_index_rules():
    ok = dict(offsets=[0, 2, 4, 6, 8], size=8, records=1, last_byte=b"\n")
    assert validate.check_index(**ok) is None
    for change, rule in (({"last_byte": b"x"}, "V2"), ({"offsets": [1, 2, 4, 6, 8]}, "V3"), ({"offsets": [0, 2, 4, 6, 7]}, "V4"), ({"offsets": [0, 2, 4, 8]}, "V5"), ({"records": 2}, "V6"), ({"offsets": [0, 4, 4, 6, 8]}, "V13")):
        assert validate.check_index(**ok | change) == rule
    assert validate.check_records([0, 2, 4], [[1, 1]]) is None
    assert validate.check_records([0, 3, 4], [[1, 1]]) == "V12"


def test_bytes_that_are_no_utf8(spark, tmp_path):
    path = put(tmp_path / "b.fq", b"@id\xff\nAC\n+\nII\n")
    assert bytes(fastq.scan(spark, path, binary=True).first().l0) == b"@id\xff"


def test_lines_of_keeps_carriage_returns(spark, tmp_path):
    path = put(tmp_path / "c.fq", "a\r\nb\n")
    assert [r.value for r in fastq.lines_of(spark, path).collect()] == ["a\r", "b"]


def frame(spark, names, bases=None, quality=None, chunk=0):
    n = len(names)
    bases = bases or ["ACGT"] * n
    quality = quality or ["I" * len(b) for b in bases]
    return spark.createDataFrame([(i, chunk, x, b, i % 2, q) for i, (x, b, q) in enumerate(zip(names, bases, quality, strict=True))], "rec long, chunk_id int, identifier string, basecalls string, plus_kind int, quality string")


@pytest.mark.parametrize(
    ("names", "mode", "kinds"),
    [
        (["a:1", "a:2"], "columnar", ["string", "int32"]),
        (["a:007", "a:2"], "columnar", ["string", "string"]),
        (["a:2147483647"], "columnar", ["string", "int32"]),
        (["a:2147483648"], "columnar", ["string", "string"]),
        (["a:0"], "columnar", ["string", "int32"]),
        (["a:+5"], "columnar", ["string", "string"]),
        ([":a:1"], "flat", None),
        (["a:1:"], "flat", None),
        (["a:1", "a/1"], "flat", None),
        (["a:1", "a:1:2"], "flat", None),
        ([f"a:{i}" for i in range(100)] + ["a:x"], "flat", None),
        ([f"a:{i}" for i in range(99)] + ["a:x"], "columnar", ["string", "string"]),
        ([f"a:{i}" for i in range(100)] + ["a"], "flat", None),
        (["a::--1"], "columnar", ["string", "int32"]),
    ],
)
def test_layout(spark, names, mode, kinds):
    reads = frame(spark, names)
    got = identifiers.modes(reads, identifiers.layout(reads)).first()
    assert (got.mode, got.kinds) == (mode, kinds)
    local = identifiers.chunk_layout(names)
    assert (local[1] if local else None) == kinds
    assert rows(chunks.decoded(chunks.encoded(reads))) == rows(reads)


@pytest.mark.parametrize("options", [Options(), Options(quality_codec="zstd", transpose=True), Options(quality_codec="none", pack_order="acgt", slice_bytes=5)])
@pytest.mark.parametrize(
    "bases",
    [["ACGT", "NNNN", "ACGN"], ["", "", ""], ["A", "", "ACGTN"], ["acgt", "ACgt", "nNaA"], ["N" * 9000, "A" * 9000, "N"]],
)
def test_round_trip(spark, options, bases):
    reads = frame(spark, ["x:1", "x:2", "x:3"], bases)
    streams = chunks.encoded(reads, options)
    assert rows(chunks.decoded(streams)) == rows(reads)
    assert container.violations(streams).count() == 0


def test_gaps_in_rec_and_several_chunks(spark):
    reads = frame(spark, ["a:1", "a:2", "a:5"]).where("rec <> 1").union(frame(spark, ["b-1"], chunk=1).selectExpr("rec + 9", "chunk_id", "identifier", "basecalls", "plus_kind", "quality"))
    assert rows(chunks.decoded(chunks.encoded(reads))) == rows(reads)
    assert rows(chunks.decoded(chunks.encoded(reads.limit(0)))) == []


def test_lost_case_is_counted(spark):
    reads = frame(spark, ["a"], ["acGT"])
    streams = chunks.encoded(reads, Options(keep_case=False))
    assert rows(chunks.decoded(streams))[0][2] == "ACGT"
    about = streams.where("stream = 'about'").first()
    assert b'"case_loss": 2' in bytes(about.payload)


def test_violations_are_found(spark):
    streams = chunks.encoded(frame(spark, ["a:1", "a:2"]))
    bad = streams.selectExpr("chunk_id", "stream", "col", "slice", "kind", "encoding", "codec", "case when stream = 'bases' then n + 4 else n end as n", "raw_bytes", "comp_bytes", "payload")
    assert [r.rule for r in container.violations(bad).collect()] == ["packed size"]


def test_a_damaged_line_index_stops_the_decoder(spark):
    import struct

    reads = frame(spark, ["a:1", "a:2"])
    streams = chunks.encoded(reads, Options(codec="none", quality_codec="none", base_codec="none"))
    for rule, lengths in (("V12", [0, 5, 5, 2, 5, 5, 5, 6, 5]), ("V3", [1, 5, 5, 2, 5, 5, 5, 5, 5]), ("V13", [0, 5, 5, 0, 5, 5, 5, 5, 5]), ("V6", [0, 5, 5, 2, 5])):
        data = struct.pack(f"<{len(lengths)}I", *lengths)
        bad = streams.rdd.map(lambda r, d=data: {**r.asDict(), **({"payload": d, "raw_bytes": len(d), "comp_bytes": len(d)} if r.stream == "line_lengths" else {})})
        with pytest.raises(Exception, match=rule):
            chunks.decoded(spark.createDataFrame(bad, streams.schema)).collect()


def test_choice_of_encoding_is_the_smallest():
    import random

    from readloom.functions import codecs, kernels

    rnd = random.Random(3)
    cases = [[7] * 500, list(range(1000)), [rnd.randrange(1 << 31) for _ in range(300)], [i * i % 997 for i in range(400)], [0], [2147483647, 0] * 50, [rnd.randrange(3) for _ in range(900)]]
    seen = set()
    for codec in codecs.NAMES:
        for v in cases:
            name, data = chunks.best_encoding(v, codec)
            d = [b - a for a, b in zip([0, *v], v, strict=False)]
            plain, delta = b"".join(x.to_bytes(4, "little", signed=True) for x in v), b"".join(((x + 2**31) % 2**32 - 2**31).to_bytes(4, "little", signed=True) for x in d)
            z, varint = [2 * x if x >= 0 else -2 * x - 1 for x in ((x + 2**31) % 2**32 - 2**31 for x in d)], bytearray()
            for x in z:
                while x > 127:
                    varint.append(x & 127 | 128)
                    x >>= 7
                varint.append(x)
            every = {"plain": plain, "delta": delta, "delta_varint": bytes(varint)}
            size = {k: len(codecs.compress(x, codec)) for k, x in every.items()}
            want = "delta_varint" if size["delta_varint"] < min(size["plain"], size["delta"]) else "delta" if size["delta"] < size["plain"] else "plain"
            assert (name, data) == (want, every[want])
            assert chunks.decoded_ints(data, name, len(v)).tolist() == v
            seen.add(name)
    assert seen == {"plain", "delta", "delta_varint"} and kernels


def test_ablation_has_both_codecs_and_transposing_acts(spark):
    quality = ["".join("FF:,#"[(i * 7 + k * k) % 5] for k in range(40)) for i in range(200)]
    reads = frame(spark, [f"a:{i}" for i in range(200)], ["ACGT" * 10] * 200, quality)
    by = {(r.variant, r.codec, r.stream): r for r in workflow.ablation(reads).collect()}
    assert {k[:2] for k in by} == {("raw", "bwt"), ("raw", "zstd"), ("split", "bwt"), ("split", "zstd"), ("full", "bwt"), ("full", "zstd"), ("full_transposed", "zstd")}
    whole = by["raw", "zstd", "all"].raw_bytes
    assert all(r.raw_bytes == whole for k, r in by.items() if k[2] == "all")
    assert by["full", "zstd", "all"].comp_bytes != by["full_transposed", "zstd", "all"].comp_bytes
    assert all((r.seconds is None) == k[0].startswith("full") and r.percent == 100 * r.comp_bytes / r.raw_bytes for k, r in by.items())


def test_ablation_exchanges_the_reads_once_and_has_the_encoder_s_sizes(spark):
    reads = frame(spark, [f"a:{i}" for i in range(300)], ["ACGTN" * 8] * 300, ["".join("FF:,#"[(i * 7 + k * k) % 5] for k in range(40)) for i in range(300)])
    reads = reads.withColumns({"chunk_id": (F.col("rec") / 100).cast("int"), "plus_kind": (F.col("rec") % 3 == 0).cast("int")})
    got = workflow.ablation(reads)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    by = {(r.variant, r.codec, r.stream): r for r in got.collect()}
    for c, turned in (("bwt", False), ("zstd", False), ("zstd", True)):
        streams = chunks.encoded(reads, Options(quality_codec=c, transpose=turned))
        assert by["full_transposed" if turned else "full", c, "all"].comp_bytes == streams.agg(F.sum("comp_bytes")).first()[0]
    every = [r.text.encode() + b"\n" for r in reads.orderBy("rec").select(fields.text().alias("text")).collect()]
    parts = [b"".join(every[k : k + 100]) for k in (0, 100, 200)]
    kinds = [[b"".join(r.split(b"\n")[k] + b"\n" for r in p) for p in (every[:100], every[100:200], every[200:])] for k in range(4)]
    for c in ("bwt", "zstd"):
        size = lambda data: sum(len(codecs.compress(x, c)) for x in data)  # noqa: B023, E731
        assert by["raw", c, "all"].comp_bytes == size(parts) and by["raw", c, "all"].raw_bytes == len(b"".join(every))
        assert [by["split", c, s].comp_bytes for s in ("identifiers", "basecalls", "plus", "quality")] == [size(k) for k in kinds]
        assert by["split", c, "all"].comp_bytes == sum(map(size, kinds))
    none = workflow.ablation(reads.where("rec < 0")).collect()
    assert sorted((r.variant, r.codec, r.raw_bytes, r.comp_bytes) for r in none) == [("full", "bwt", None, None), ("full", "zstd", None, None), ("full_transposed", "zstd", None, None)]
    with pytest.raises(ValueError, match="differ in quality_codec"):
        list(chunks.coded(0, None, (Options(), Options(codec="none"))))


@pytest.mark.parametrize("name", ["ablation", "ablation_report"])
def test_ablation_queries_derive_the_reads_once(spark, tmp_path, name):
    from readloom import queries

    spark.range(20).selectExpr("id as event_id", "id as user_id", "'view' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("parquet") == 1
    assert {r.raw_bytes for r in got.where("variant <> 'split'").collect()} == {got.where("variant = 'split' and stream <> 'all' and codec = 'zstd'").groupBy().sum("raw_bytes").first()[0]}


@pytest.mark.parametrize("name", ["scan_fastq", "scan_fastq_faulty"])
def test_scan_queries_derive_the_reads_once_and_after_the_exchange(spark, tmp_path, monkeypatch, name):
    from readloom import queries

    events = spark.range(3000).selectExpr("id as event_id", "id as user_id", "'view' as event_type")
    events.repartition(3, F.hash("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(fixtures, "LEAST", 500)
    frames, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: frames.append(self._df) or text(self, *a, **k))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    plan = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("md5(") < plan.index("Sort") and plan.count("parquet") == 1  # what is above comes later
    assert frames[0].rdd.getNumPartitions() == 6
    reads = fixtures.reads(spark, str(tmp_path))
    if name == "scan_fastq":
        assert sorted(got) == reads.select(*queries.READS).orderBy("rec").collect()
    else:
        assert sorted(got) == sorted(validate.rejected(fixtures.faulty(fields.raw_lines(reads))).select("rec", "error").collect()) and len(got) == 18


def test_events_in_order_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "LEAST", 10)
    monkeypatch.setattr(fixtures, "MOST", 50)
    cores = spark.sparkContext.defaultParallelism
    for rows, n in ((0, 1), (9, 1), (30, 3), (10 * 4 * cores + 90, 4 * cores), (50 * 4 * cores + 60, 4 * cores + 2)):
        got = fixtures.in_order(spark.range(rows).selectExpr(f"({rows} - 1 - id) as event_id")).rdd
        assert got.getNumPartitions() == n and [r.event_id for r in got.collect()] == list(range(rows))


def test_a_repeated_token_is_judged_once(monkeypatch):
    seen, judge = [], identifiers.int_text
    monkeypatch.setattr(identifiers, "int_text", lambda v: seen.append(v) or judge(v))
    names = [f"a:{i % 7}:{i}" for i in range(1000)]
    assert identifiers.chunk_layout(names)[1] == ["string", "int32", "int32"]
    assert len(seen) < 1300  # 201 in the sample, 7 and 1,000 values
    assert identifiers.chunk_layout([*names, "a:x:5"]) is None and identifiers.chunk_layout([*names, "a:01:5"]) is None


def test_options_are_checked():
    for bad in ({"quality_codec": "x"}, {"pack_order": "gatc"}, {"slice_bytes": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def binary_chunk(records, columnar=True, version=18):
    columns = [{"kind": 1, "encoding": 2, "text": 9, "original": 12, "payload": 5, "parts": 2, "lengths_original": 0, "lengths_payload": 0, "lengths_parts": 0, "values_of": [2, 3], "lengths_of": []}, {"kind": 0, "encoding": 0, "text": 6, "original": 6, "payload": 4, "parts": 1, "lengths_original": 12, "lengths_payload": 3, "lengths_parts": 1, "values_of": [4], "lengths_of": [3]}] if columnar else []
    fields_ = {"records": records, "line_offsets": 4 * records + 1, "id_mode": int(columnar), "id_flat_payload": 0 if columnar else 7, "n_block": 8192, "pack_order": 1, "packed_payload": 6, "n_counts_payload": 2, "n_positions_payload": 0, "quality_codec": 1, "quality_layout": 1, "quality_fixed_len": 4, "quality_payload": 8, "line_payload": 9}
    payloads = [b"F" * fields_["id_flat_payload"], *([b"v" * 5, b"", b"w" * 4, b"l" * 3] if columnar else []), b"P" * 6, b"nc", b"", b"q" * 8, b"i" * 9]
    return binary.pack_chunk({"fields": fields_, "separators": [":", " "][:1] if columnar else [], "kinds": [1, 0] if columnar else [], "columns": columns, "flat_parts": [] if columnar else [3, 4], "tables": [[6], [9], [], [8], [16], [4, 5]], "plus": bytes(k % 2 for k in range(records)), "payloads": payloads}, version)


def test_binary_containers(spark, tmp_path):
    for version in (16, 17, 18):
        put(tmp_path / f"v{version}.bin", binary.pack_header(version) + binary_chunk(3, True, version) + binary_chunk(2, False, version) + binary_chunk(0, True, version))
    put(tmp_path / "empty.bin", binary.pack_header())
    got = {(r.version, r.chunk): r for r in binary.chunks(spark, str(tmp_path)).collect()}
    assert set(got) == {(v, k) for v in (16, 17, 18) for k in range(3)}
    data = (tmp_path / "v18.bin").read_bytes()
    for (version, k), r in got.items():
        assert (r.records, r.id_mode) == ((3, 2, 0)[k], "flat" if k == 1 else "columnar")
        assert r.separators == ([] if k == 1 else [":"]) and r.kinds == ([] if k == 1 else ["int32", "string"])
        assert [(c.kind, c.encoding, c.text) for c in r.columns] == ([] if k == 1 else [("int32", "delta_varint", 9), ("string", "plain", 6)])
        assert (r.pack_order, r.quality_codec, r.quality_layout, r.quality_fixed_len, r.transposed) == ("tgca", "zstd", "fixed", 4, False)
        assert (r.bare_plus, r.copied_plus) == ((r.records, 0) if version < 18 else ((2, 1), (1, 1), (0, 0))[k])
        if version == 18:
            of = {s.name: (data[s.at : s.at + s.bytes], s.parts) for s in r.streams}
            assert of["packed"] == (b"P" * 6, [6]) and of["line_lengths"] == (b"i" * 9, [4, 5]) and of["quality"][0] == b"q" * 8 and of["n_counts"] == (b"nc", [2])
            assert of["id_flat"] == ((b"F" * 7, [3, 4]) if k == 1 else (b"", []))
            assert k == 1 or (of["id_values 0"] == (b"v" * 5, [2, 3]) and of["id_lengths 1"] == (b"l" * 3, [3]))
    whole = binary.pack_header() + binary_chunk(3)
    for n in (9, 100, 240, 300, len(whole) - 1):
        with pytest.raises(Exception, match="cut short"):
            binary.chunks(spark, put(tmp_path / "cut.bin", whole[:n])).collect()


def test_headers():
    values = {"records": 3, "n_block": 8192, "plus_kinds": 3}
    for version, size in ((16, 213), (17, 214), (18, 222)):
        data = binary.pack_fields(values, version)
        assert len(data) == size
        got = binary.unpack_fields(data, version)
        assert got["records"] == 3 and got["n_block"] == 8192
    assert binary.unpack_fields(b"") is None
    for call in (lambda: binary.unpack_header(b"1234"), lambda: binary.unpack_header(b"12345678"), lambda: binary.unpack_header(binary.pack_header(15)), lambda: binary.unpack_fields(b"abc")):
        with pytest.raises(ValueError):
            call()


def test_workflow_and_command_line(spark, tmp_path, capsys, monkeypatch):
    source = put(tmp_path / "r.fq", "".join(record(i, "ACGTN" * 4, plus=f"+R:{i}:x {i * 3}" if i % 3 == 0 else "+") for i in range(50)))
    assert cli.main(["compress", source, str(tmp_path / "c"), "--quality-codec", "zstd", "--stat", "--log-stat", str(tmp_path / "log")], spark) == 0
    assert '"records": 50' in (tmp_path / "log").read_text()
    assert cli.main(["decompress", str(tmp_path / "c"), str(tmp_path / "d")], spark) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    assert text == (tmp_path / "r.fq").read_text()
    assert cli.main(["roundtrip", source, str(tmp_path / "t"), "--transpose"], spark) == 0
    assert "PASSED" in capsys.readouterr().out
    assert cli.main(["compress", str(tmp_path / "none"), str(tmp_path / "n")], spark) == 1
    assert container.first_chunk(spark, str(tmp_path / "c")).select("chunk_id").distinct().count() == 1
    assert '"index_seconds"' in (tmp_path / "log").read_text()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["compress", "a", "b", "--chunk-bytes", "0"])
    monkeypatch.setenv("READLOOM_BASE_CODEC", "bwt")
    monkeypatch.setenv("READLOOM_CHUNK_BYTES", "1000")
    a = cli.parser().parse_args(["compress", "a", "b"])
    assert (a.base_codec, a.chunk_bytes) == ("bwt", 1000) and cli.parser().parse_args(["compress", "a", "b", "--base-codec", "none"]).base_codec == "none"
    monkeypatch.setenv("READLOOM_BASE_CODEC", "x")
    assert cli.main(["compress", "a", "b"], spark) == 2


def test_an_empty_input_makes_a_valid_container(spark, tmp_path):
    got = workflow.compress(spark, put(tmp_path / "e.fq", ""), str(tmp_path / "c"))
    assert got["records"] == 0 and got["payload_percent"] == 0
    assert chunks.decoded(container.read(spark, str(tmp_path / "c"))).count() == 0


def test_differences(spark):
    a = frame(spark, ["a", "b"])
    assert fields.differences(a, a).first().asDict() == {"records_in": 2, "records_out": 2, "differences": 0}
    assert fields.differences(a, a.where("rec = 0").union(a.where("rec = 0"))).first().differences == 2


def test_stream_of_chunks(spark, tmp_path):
    from readloom.streaming.chunk_stream import encode_stream

    reads = frame(spark, ["a:1", "a:2"])
    reads.write.parquet(str(tmp_path / "in"))
    q = encode_stream(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    back = chunks.decoded(spark.read.parquet(str(tmp_path / "out/streams")).drop("batch"))
    assert rows(back) == rows(reads)
