"""The engine's queries by name, each over the reads of `events`, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import chunks, encode, fields, identifiers, validate
from .operators.chunks import Options
from .plans import fixtures, workflow
from .plans.fixtures import FAULTY, RAW, cte, faulty, reads
from .sources import container, fastq
from .storage import shared_dir

READS = ("rec", "identifier", "basecalls", "plus_kind", "quality")


def scan_fastq(spark, sf_dir):
    path = shared_dir(spark, "fastq")
    fastq.write(reads(spark, sf_dir, ordered=True), path, ordered=True)
    return fastq.read(spark, path, partition_bytes=1 << 18).select(*READS)


def scan_fastq_faulty(spark, sf_dir):
    """What a scan in small ranges rejects from a file with faults."""
    path = shared_dir(spark, "faulty")
    raw = faulty(fields.raw_lines(reads(spark, sf_dir, ordered=True)))
    raw.select(F.concat_ws("\n", *validate.LINES)).write.text(path)
    return validate.rejected(fastq.scan(spark, path, 1 << 15)).select("rec", "error")


def layouts(spark, sf_dir, drift=False):
    r = reads(spark, sf_dir, drift=drift)
    return r, identifiers.modes(r, identifiers.layout(r))


def typed(spark, sf_dir):
    r, mode = layouts(spark, sf_dir)
    return identifiers.columns(r, mode), mode


def id_layout(spark, sf_dir, drift=False):
    mode = layouts(spark, sf_dir, drift)[1]
    return mode.select("chunk_id", "records", "mode", F.array_join("sep", "|").alias("seps"), F.array_join("kinds", ",").alias("kinds"))


def stored(spark, sf_dir, options=None):
    path = shared_dir(spark, "container")
    container.write(chunks.encoded(reads(spark, sf_dir), options), path, options)
    return container.read(spark, path)


def text_md5(d: DataFrame) -> DataFrame:
    return d.select("rec", F.md5(F.concat(fields.text(), F.lit("\n"))).alias("md5"))


def encoding_choice(spark, sf_dir):
    """Choice of encoding where a codec changes no size."""
    s = chunks.encoded(reads(spark, sf_dir), Options(codec="none")).where("stream = 'id_values'")
    return s.groupBy("chunk_id", "col").agg(F.max("kind").alias("kind"), F.max("encoding").alias("encoding"), F.sum("text_bytes").alias("text_bytes"), F.sum("raw_bytes").alias("raw_bytes"))


#: rule -> (rows to change, column, new value; none: the rows go)
STREAM_FAULTS = {
    "packed size": ("stream = 'bases'", "raw_bytes", "raw_bytes + 4"),
    "n counts size": ("stream = 'n_counts'", "raw_bytes", "raw_bytes + 2"),
    "n positions size": ("stream = 'n_positions'", "raw_bytes", "raw_bytes + 2"),
    "plus kinds": ("stream = 'plus'", "raw_bytes", "raw_bytes + 1"),
    "line lengths": ("stream = 'line_lengths'", "raw_bytes", "raw_bytes + 4"),
    "quality size": ("stream = 'quality'", "raw_bytes", "raw_bytes + 1"),
    "string column lengths": ("stream = 'id_lengths' and col = 0", "raw_bytes", "raw_bytes + 4"),
    "string column encoding": ("stream = 'id_values' and col = 0", "encoding", "'delta'"),
    "stream sizes": ("stream = 'quality'", "comp_bytes", "comp_bytes + 1"),
    "slice numbers": ("stream = 'quality'", "slice", "slice + 1"),
    "codec names": ("stream = 'bases'", "codec", "'lzma'"),
    "column kinds": ("stream = 'id_values' and col = 1", "kind", "'float'"),
    "column encodings": ("stream = 'id_values' and col = 1", "encoding", "'rle'"),
    "layout names": ("stream = 'about'", "payload", "cast(replace(cast(payload as string), 'variable', 'varyable') as binary)"),
    "columns and separators": ("stream in ('id_values', 'id_lengths') and col = 6", None, None),
    "missing streams": ("stream = 'quality'", None, None),
}


def faulty_streams(streams: DataFrame) -> DataFrame:
    """Each chunk as it is and, numbered chunk_id * 100 + k, with the k-th of these faults."""
    rows = streams.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(STREAM_FAULTS)))).alias("k"))
    for k, (on, column, value) in enumerate(STREAM_FAULTS.values(), 1):
        on = F.expr(f"k = {k} and {on}")
        rows = rows.withColumn(column, F.when(on, F.expr(value)).otherwise(F.col(column))) if column else rows.where(~on)
    return rows.withColumn("chunk_id", (F.col("chunk_id") * 100 + F.col("k")).cast("int")).drop("k")


def index_faults(spark, sf_dir):
    """Rules that line indexes break: each chunk's as it is and, numbered chunk_id * 10 + k, with the k-th fault."""
    raw = fields.raw_lines(reads(spark, sf_dir))
    lines = fields.lines(raw)
    sizes = lines.groupBy("chunk_id").agg(F.sum("len").alias("size"), (F.count("*") / 4).cast("long").alias("records"), F.min("line").alias("first"), F.max("line").alias("last"))
    k = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")
    number = (F.col("chunk_id") * 10 + F.col("k")).cast("int")
    all_ = sizes.select("*", k)
    rows = fields.line_index(lines).join(sizes, "chunk_id").select("*", k)
    off = F.expr("case when k = 1 and line = first then off + 1 when k = 2 and line = last + 1 then off - 1 when k = 5 and line = first + 2 then off - len1 else off end")
    step = F.col("off") - F.lag("off").over(Window.partitionBy("chunk_id", "k").orderBy("line"))
    rows = rows.withColumn("len1", step).withColumn("off", off).where("not (k = 3 and line = first + 1)")
    chunks_ = all_.select(number.alias("chunk_id"), F.expr("case when k = 6 then 0 else size end").alias("size"), F.expr("case when k = 4 then records + 1 else records end").alias("records"))
    return validate.index_errors(rows.select(number.alias("chunk_id"), "line", "off"), chunks_)


def plain_sizes(spark, sf_dir):
    """The choice of encoding by uncompressed size."""
    d = encode.int_deltas(typed(spark, sf_dir)[0])
    by = d.groupBy("chunk_id", "col").agg((F.count("*") * 4).alias("plain_bytes"), F.sum(encode.varint_size(encode.zigzag(F.col("delta")))).cast("long").alias("varint_bytes"))
    return by.withColumn("choice", F.when(F.col("varint_bytes") < F.col("plain_bytes"), "delta_varint").otherwise("plain"))


def zigzags(spark, sf_dir):
    d = encode.int_deltas(typed(spark, sf_dir)[0]).withColumn("z", encode.zigzag(F.col("delta")))
    return d.select("chunk_id", "rec", "col", "delta", "z", encode.unzigzag(F.col("z")).alias("back"))


def packed(order):
    def run(spark, sf_dir):
        return encode.packed(reads(spark, sf_dir), order).select("chunk_id", "bases", F.octet_length("packed").cast("long").alias("bytes"), F.md5(F.lower(F.hex("packed"))).alias("md5"))

    return run


def validated(spark, sf_dir):
    raw = fields.raw_lines(reads(spark, sf_dir))
    return validate.checked(faulty(raw))


def index(spark, sf_dir):
    return fields.line_index(fields.lines(fields.raw_lines(reads(spark, sf_dir))))


QUERIES = {
    "field_stats": lambda s, d: fields.field_stats(reads(s, d)),
    "scan_fastq": scan_fastq,
    "scan_fastq_faulty": scan_fastq_faulty,
    "line_index": index,
    "line_lengths_delta": lambda s, d: fields.offset_deltas(index(s, d)),
    "line_offsets_restore": lambda s, d: fields.offsets_restored(fields.offset_deltas(index(s, d))),
    "validate_ok_count": lambda s, d: validated(s, d).agg(F.count("*").alias("records"), F.count_if(F.col("error").isNull()).alias("good")),
    "validate_errors": lambda s, d: validated(s, d).where("error is not null").select("rec", "error"),
    "quality_layout": lambda s, d: fields.quality_layout(reads(s, d)),
    "quality_layout_fixed": lambda s, d: fields.quality_layout(reads(s, d, fixed=True)),
    "n_totals": lambda s, d: fields.n_totals(reads(s, d)),
    "field_lengths_offsets": lambda s, d: fields.field_offsets(reads(s, d)),
    "plus_kinds": lambda s, d: validate.parsed(fields.raw_lines(reads(s, d))).groupBy("plus_kind").agg(F.count("*").alias("records")),
    "id_tokens": lambda s, d: identifiers.tokenized(reads(s, d)).select("rec", F.array_join("tok", "|").alias("tokens"), F.size("tok").alias("n_tokens")),
    "id_separators": lambda s, d: identifiers.tokenized(reads(s, d)).select("rec", F.array_join("sep", "|").alias("seps"), F.size("sep").alias("n_seps")),
    "id_int_check": lambda s, d: identifiers.tokenized(reads(s, d)).select("rec", F.posexplode("tok").alias("col", "tok")).select("rec", "col", identifiers.canonical(F.col("tok")).alias("is_int")),
    "id_layout": id_layout,
    "id_layout_drift": lambda s, d: id_layout(s, d, drift=True),
    "id_typed_columns": lambda s, d: typed(s, d)[0],
    "id_string_lengths": lambda s, d: typed(s, d)[0].where("kind = 'string'").groupBy("chunk_id", "col").agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest")),
    "id_flat_stream": lambda s, d: identifiers.flat(reads(s, d, drift=True)).select("chunk_id", F.md5("stream").alias("md5"), F.octet_length("stream").alias("bytes")),
    "id_delta": lambda s, d: encode.int_deltas(typed(s, d)[0]),
    "id_delta_restore": lambda s, d: encode.ints_restored(encode.int_deltas(typed(s, d)[0])),
    "id_zigzag": zigzags,
    "id_varint_sizes": plain_sizes,
    "id_varint_bytes": lambda s, d: encode.varint_streams(encode.int_deltas(typed(s, d)[0])).select("chunk_id", "col", "n", F.md5(F.lower(F.hex("bytes"))).alias("md5")),
    "id_varint_decode": lambda s, d: encode.varints_read(encode.varint_streams(encode.int_deltas(typed(s, d)[0]))).groupBy("chunk_id", "col").agg(F.count("*").alias("n"), F.sum("delta").alias("total"), F.sum(F.col("delta") * (F.col("k") + 1)).alias("weighted")),
    "id_encoding_choice": encoding_choice,
    "id_rebuild": lambda s, d: identifiers.rebuilt(*typed(s, d)),
    "base_pack_tgca": packed("tgca"),
    "base_pack_acgt": packed("acgt"),
    "n_block_counts": lambda s, d: encode.n_counts(reads(s, d)),
    "n_positions_delta": lambda s, d: encode.n_positions(reads(s, d)),
    "base_unpack": lambda s, d: encode.bases_round_trip(reads(s, d)).select("rec", "basecalls"),
    "quality_transpose": lambda s, d: encode.transposed(reads(s, d, fixed=True)).select("chunk_id", "n", "width", F.md5("stream").alias("md5")),
    "quality_untranspose": lambda s, d: encode.untransposed(encode.transposed(reads(s, d, fixed=True))).select((F.col("chunk_id") * fixtures.CHUNK + F.col("k")).alias("rec"), "quality"),
    "rebuild_fastq": lambda s, d: text_md5(chunks.decoded(chunks.encoded(reads(s, d)))),
    "roundtrip_check": lambda s, d: fields.differences(reads(s, d), chunks.decoded(stored(s, d))),
    "roundtrip_transposed": lambda s, d: fields.differences(reads(s, d, fixed=True), chunks.decoded(chunks.encoded(reads(s, d, fixed=True), Options(transpose=True, quality_codec="zstd", pack_order="acgt")))),
    "roundtrip_drift": lambda s, d: fields.differences(reads(s, d, drift=True), chunks.decoded(chunks.encoded(reads(s, d, drift=True)))),
    "split_naive": lambda s, d: fields.naive_split(reads(s, d)),
    "container_write_read": lambda s, d: chunks.decoded(stored(s, d)).select(*READS),
    "container_violations": lambda s, d: container.violations(faulty_streams(stored(s, d))),
    "index_errors": index_faults,
    "container_totals": lambda s, d: workflow.totals(stored(s, d)).select("records", "raw_bytes", (F.col("comp_bytes") < F.col("raw_bytes")).alias("smaller")),
    "codec_sizes": lambda s, d: workflow.by_stream(stored(s, d)).where("stream not in ('about', 'case', 'rec')").select("stream", "col", "kind", "raw_bytes", (F.col("comp_bytes") > 0).alias("stored")),
    "codec_report": lambda s, d: workflow.by_stream(stored(s, d)),
    "ablation": lambda s, d: workflow.ablation(reads(s, d, fixed=True)).select("variant", "codec", "stream", "raw_bytes", (F.col("comp_bytes") < F.col("raw_bytes")).alias("smaller")),
    "ablation_report": lambda s, d: workflow.ablation(reads(s, d, fixed=True)),
}

# ---- the oracles

ROWS = f"with {cte()}"
LINES = f"{ROWS}, {RAW}, lines as (select chunk_id, rec * 4 as line, strlen(l0) + 1 as len from raw union all select chunk_id, rec * 4 + 1, strlen(l1) + 1 from raw union all select chunk_id, rec * 4 + 2, strlen(l2) + 1 from raw union all select chunk_id, rec * 4 + 3, strlen(l3) + 1 from raw)"
INDEX = f"{LINES}, ix as (select chunk_id, line, cast(sum(len) over (partition by chunk_id order by line rows unbounded preceding) - len as bigint) as off from lines union all select chunk_id, max(line) + 1, cast(sum(len) as bigint) from lines group by chunk_id)"
ERRORS = """checked as (select rec, case
  when substr(l0, 1, 1) <> '@' then 'V7' when substr(l2, 1, 1) <> '+' then 'V8' when strlen(l0) = 1 then 'V9'
  when l2 <> '+' and substr(l2, 2) <> substr(l0, 2) then 'V10' when strlen(l1) <> strlen(l3) then 'V11'
  when regexp_matches(l1, '[^ACGTNacgtn]') then 'V15' end as error from faulty)"""
QUALITY = "select chunk_id, count(*) as records, min(strlen(quality)) as min_len, max(strlen(quality)) as max_len, case when min(strlen(quality)) = max(strlen(quality)) then 'fixed' else 'variable' end as layout, case when min(strlen(quality)) = max(strlen(quality)) then min(strlen(quality)) else 0 end as fixed_len from reads group by chunk_id"
TOK = r"tok as (select rec, chunk_id, identifier, regexp_split_to_array(identifier, '[:/\-.\s]+') as t, regexp_extract_all(identifier, '([:/\-.\s]+)', 1) as s from reads)"
INT = r"(regexp_full_match({0}, '0|[1-9][0-9]*') and strlen({0}) <= 10 and try_cast({0} as bigint) <= 2147483647)"
EACH = "each as (select rec, chunk_id, unnest(t) as text, unnest(range(0, len(t))) as col from tok)"
LAYOUT = f"""first as (select * from (select tok.*, row_number() over (partition by chunk_id order by rec) as k from tok) where k <= 100),
heads as (select chunk_id, min(len(t)) as least, max(len(t)) as most, count(distinct array_to_string(s, '|')) as seps, min(array_to_string(s, '|')) as sep, bool_and(len(s) + 1 = len(t)) as even from first group by chunk_id),
kinds as (select chunk_id, col, case when bool_and(coalesce({INT.format('text')}, false)) then 'int32' else 'string' end as kind from (select chunk_id, unnest(t) as text, unnest(range(0, len(t))) as col from first) group by chunk_id, col),
misfit as (select distinct e.chunk_id from each e join kinds k on e.chunk_id = k.chunk_id and e.col = k.col where k.kind = 'int32' and not coalesce({INT.format('e.text')}, false)),
ok as (select tok.chunk_id, count(*) as records, bool_and(array_to_string(tok.s, '|') = h.sep and len(tok.t) = h.least) as same from tok join heads h on tok.chunk_id = h.chunk_id group by tok.chunk_id),
mode as (select ok.chunk_id, ok.records, case when same and even and seps = 1 and least = most and ok.chunk_id not in (select chunk_id from misfit) then 'columnar' else 'flat' end as mode, sep from ok join heads on ok.chunk_id = heads.chunk_id)"""
MODES = "select m.chunk_id, m.records, m.mode, case when m.mode = 'columnar' then sep end as seps, case when m.mode = 'columnar' then (select string_agg(kind, ',' order by col) from kinds k where k.chunk_id = m.chunk_id) end as kinds from mode m"
TYPED = f"{ROWS}, {TOK}, {EACH}, typed as (select chunk_id, rec, cast(col as int) as col, case when col in (0, 2, 6) then 'string' else 'int32' end as kind, text, case when col in (0, 2, 6) then null else cast(text as int) end as value from each)"
DELTAS = f"{TYPED}, deltas as (select chunk_id, rec, col, value, cast(value - coalesce(lag(value) over (partition by chunk_id, col order by rec), 0) as int) as delta from typed where kind = 'int32'), zz as (select *, case when delta >= 0 then 2 * cast(delta as bigint) else -2 * cast(delta as bigint) - 1 end as z from deltas)"
SIZE = "case when z < 128 then 1 when z < 16384 then 2 when z < 2097152 then 3 when z < 268435456 then 4 else 5 end"
BASES = "bases as (select chunk_id, b, row_number() over (partition by chunk_id order by rec, i) - 1 as g from (select rec, chunk_id, unnest(range(1, strlen(basecalls) + 1)) as i, unnest(string_split(basecalls, '')) as b from reads))"
NS = "ns as (select chunk_id, g // 8192 as blk, g % 8192 as pos from bases where b = 'N')"


def pack_sql(order: str) -> str:
    code = "case b " + " ".join(f"when '{b}' then {k}" for k, b in enumerate(order)) + f" else {order.index('A')} end"
    return f"{ROWS}, {BASES}, bytes as (select chunk_id, g // 4 as byte, sum({code} * power(4, g % 4)) as v, count(*) as n from bases group by chunk_id, g // 4) select chunk_id, cast(sum(n) as bigint) as bases, count(*) as bytes, md5(string_agg(format('{{:02x}}', cast(v as bigint)), '' order by byte)) as md5 from bytes group by chunk_id"


VARINT_HEX = "concat(" + ", ".join(f"case when n > {k} then format('{{:02x}}', cast(((z // {128**k}) % 128) + case when n > {k + 1} then 128 else 0 end as bigint)) else '' end" for k in range(5)) + ")"
SAME = "select count(*) as records_in, count(*) as records_out, cast(0 as bigint) as differences from events"
RECORD = "concat('@', identifier, chr(10), basecalls, chr(10), '+', case when plus_kind = 1 then identifier else '' end, chr(10), quality, chr(10))"

ORACLE_SQL = {
    "field_stats": f"{ROWS} select count(*) as records, cast(sum(strlen(identifier)) as bigint) as identifier_bytes, cast(sum(strlen(basecalls)) as bigint) as basecall_bytes, cast(sum(strlen(quality)) as bigint) as quality_bytes, (count(*) * 4 + 1) * 4 as line_length_bytes from reads",
    "scan_fastq": f"{ROWS} select {', '.join(READS)} from reads",
    "scan_fastq_faulty": f"{ROWS}, {RAW}, {FAULTY}, {ERRORS} select rec, error from checked where error is not null",
    "line_index": f"{INDEX} select * from ix",
    "line_lengths_delta": f"{INDEX} select chunk_id, line, off - lag(off, 1, 0) over (partition by chunk_id order by line) as delta from ix",
    "line_offsets_restore": f"{INDEX} select * from ix",
    "validate_ok_count": f"{ROWS}, {RAW}, {FAULTY}, {ERRORS} select count(*) as records, count(*) - count(error) as good from checked",
    "validate_errors": f"{ROWS}, {RAW}, {FAULTY}, {ERRORS} select rec, error from checked where error is not null",
    "quality_layout": f"{ROWS} {QUALITY}",
    "quality_layout_fixed": f"with {cte(fixed=True)} {QUALITY}",
    "n_totals": f"{ROWS} select chunk_id, cast(sum(strlen(basecalls)) as bigint) as bases, cast(sum(strlen(basecalls) - strlen(replace(basecalls, 'N', ''))) as bigint) as n_bases from reads group by chunk_id",
    "field_lengths_offsets": f"{ROWS}, l as (select rec, chunk_id, cast(strlen(identifier) as bigint) as id_len, cast(strlen(basecalls) as bigint) as seq_len, cast(strlen(quality) as bigint) as qual_len from reads) select *, cast(sum(id_len) over w - id_len as bigint) as id_len_off, cast(sum(seq_len) over w - seq_len as bigint) as seq_len_off, cast(sum(qual_len) over w - qual_len as bigint) as qual_len_off from l window w as (order by rec rows unbounded preceding)",
    "plus_kinds": f"{ROWS} select plus_kind, count(*) as records from reads group by plus_kind",
    "id_tokens": f"{ROWS}, {TOK} select rec, array_to_string(t, '|') as tokens, len(t) as n_tokens from tok",
    "id_separators": f"{ROWS}, {TOK} select rec, array_to_string(s, '|') as seps, len(s) as n_seps from tok",
    "id_int_check": f"{ROWS}, {TOK}, {EACH} select rec, col, coalesce({INT.format('text')}, false) as is_int from each",
    "id_layout": f"{ROWS}, {TOK}, {EACH}, {LAYOUT} {MODES}",
    "id_layout_drift": f"with {cte(drift=True)}, {TOK}, {EACH}, {LAYOUT} {MODES}",
    "id_typed_columns": f"{TYPED} select * from typed",
    "id_string_lengths": f"{TYPED} select chunk_id, col, cast(sum(strlen(text)) as bigint) as bytes, max(strlen(text)) as longest from typed where kind = 'string' group by chunk_id, col",
    "id_flat_stream": f"with {cte(drift=True)} select chunk_id, md5(string_agg(identifier, '' order by rec)) as md5, cast(sum(strlen(identifier)) as bigint) as bytes from reads group by chunk_id",
    "id_delta": f"{DELTAS} select * from deltas",
    "id_delta_restore": f"{DELTAS} select chunk_id, rec, col, value from deltas",
    "id_zigzag": f"{DELTAS} select chunk_id, rec, col, delta, z, delta as back from zz",
    "id_varint_sizes": f"{DELTAS}, s as (select chunk_id, col, count(*) * 4 as plain_bytes, cast(sum({SIZE}) as bigint) as varint_bytes from zz group by chunk_id, col) select *, case when varint_bytes < plain_bytes then 'delta_varint' else 'plain' end as choice from s",
    "id_varint_bytes": f"{DELTAS}, sized as (select *, {SIZE} as n from zz) select chunk_id, col, count(*) as n, md5(string_agg({VARINT_HEX}, '' order by rec)) as md5 from sized group by chunk_id, col",
    "id_varint_decode": f"{DELTAS}, k as (select chunk_id, col, delta, row_number() over (partition by chunk_id, col order by rec) as k from deltas) select chunk_id, col, count(*) as n, cast(sum(delta) as bigint) as total, cast(sum(delta * k) as bigint) as weighted from k group by chunk_id, col",
    "id_rebuild": f"{ROWS} select chunk_id, rec, identifier from reads",
    "base_pack_tgca": pack_sql("TGCA"),
    "base_pack_acgt": pack_sql("ACGT"),
    "n_block_counts": f"{ROWS}, {BASES} select chunk_id, g // 8192 as blk, cast(sum(case when b = 'N' then 1 else 0 end) as bigint) as n_count from bases group by chunk_id, g // 8192",
    "n_positions_delta": f"{ROWS}, {BASES}, {NS} select chunk_id, blk, pos, pos - coalesce(lag(pos) over (partition by chunk_id, blk order by pos), 0) as delta from ns",
    "base_unpack": f"{ROWS} select rec, basecalls from reads",
    "quality_transpose": f"with {cte(fixed=True)}, c as (select chunk_id, rec, unnest(range(1, 65)) as i, unnest(string_split(quality, '')) as q from reads) select chunk_id, count(*) // 64 as n, 64 as width, md5(string_agg(q, '' order by i, rec)) as md5 from c group by chunk_id",
    "quality_untranspose": f"with {cte(fixed=True)} select rec, quality from reads",
    "rebuild_fastq": f"{ROWS} select rec, md5({RECORD}) as md5 from reads",
    "roundtrip_check": SAME,
    "roundtrip_transposed": SAME,
    "roundtrip_drift": SAME,
    "split_naive": f"{ROWS}, {RAW} select 'identifiers' as stream, cast(sum(strlen(l0) + 1) as bigint) as raw_bytes from raw union all select 'basecalls', cast(sum(strlen(l1) + 1) as bigint) from raw union all select 'plus', cast(sum(strlen(l2) + 1) as bigint) from raw union all select 'quality', cast(sum(strlen(l3) + 1) as bigint) from raw",
    "container_write_read": f"{ROWS} select {', '.join(READS)} from reads",
    "container_violations": f"{ROWS}, faults as (select unnest({list(STREAM_FAULTS)}) as rule, unnest(range(1, {len(STREAM_FAULTS) + 1})) as k) select cast(c.chunk_id * 100 + k as int) as chunk_id, rule from (select distinct chunk_id from reads) c, faults",
    "index_errors": f"{ROWS}, faults as (select unnest(['V3', 'V4', 'V5', 'V6', 'V13', 'V1']) as error, unnest(range(1, 7)) as k) select cast(c.chunk_id * 10 + k as int) as chunk_id, error from (select distinct chunk_id from reads) c, faults",
    "container_totals": f"{ROWS}, sized as (select chunk_id, count(*) as n, sum(strlen(identifier) + strlen(basecalls) + strlen(quality)) as b from reads group by chunk_id) select cast(sum(n) as bigint) as records, cast(sum(b + 4 * (4 * n + 1)) as bigint) as raw_bytes, true as smaller from sized",
    "codec_sizes": f"{TYPED}, {BASES}, {NS}, n as (select chunk_id, count(*) as n, sum(strlen(basecalls)) as b, sum(strlen(quality)) as q from reads group by chunk_id), sizes as (select 'id_column' as stream, col, kind, sum(strlen(text) + case when kind = 'string' then 4 else 0 end) as raw_bytes from typed group by col, kind union all select 'bases', -1, '', sum(b) from n union all select 'quality', -1, '', sum(q) from n union all select 'line_lengths', -1, '', sum(4 * (4 * n + 1)) from n union all select 'plus', -1, '', sum(n) from n union all select 'n_counts', -1, '', sum(2 * ((b + 8191) // 8192)) from n union all select 'n_positions', -1, '', 2 * (select count(*) from ns)) select stream, cast(col as int) as col, kind, cast(raw_bytes as bigint) as raw_bytes, true as stored from sizes",
    "id_encoding_choice": f"{DELTAS}, s as (select chunk_id, col, count(*) * 4 as p, cast(sum({SIZE}) as bigint) as v from zz group by chunk_id, col), t as (select chunk_id, col, kind, cast(sum(strlen(text)) as bigint) as text_bytes from typed group by chunk_id, col, kind) select t.chunk_id, t.col, t.kind, case when v < p then 'delta_varint' else 'plain' end as encoding, text_bytes, cast(case when kind = 'string' then text_bytes when v < p then v else p end as bigint) as raw_bytes from t left join s on t.chunk_id = s.chunk_id and t.col = s.col",
    "ablation": f"with {cte(fixed=True)}, {RAW}, sized as (select 'identifiers' as stream, strlen(l0) + 1 as b from raw union all select 'basecalls', strlen(l1) + 1 from raw union all select 'plus', strlen(l2) + 1 from raw union all select 'quality', strlen(l3) + 1 from raw), streams as (select stream, sum(b) as b from sized group by stream union all select 'all', sum(b) from sized), cases as (select unnest(['raw', 'raw', 'split', 'split', 'full', 'full', 'full_transposed']) as variant, unnest(['bwt', 'zstd', 'bwt', 'zstd', 'bwt', 'zstd', 'zstd']) as codec) select variant, codec, stream, cast(b as bigint) as raw_bytes, true as smaller from cases, streams where stream = 'all' or variant = 'split'",
}
