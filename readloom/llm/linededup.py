"""Substring dedup by hashing lines and the sentences in them (method 6).

A unit ends at a line break or after a run of . ! ? before white space. Units are
normalised to their lower-cased words and hashed (128 bits). Digests are grouped over all
documents; the occurrence ranked first (least doc_id, then position) is kept, the others
are repeats and are removed. Adjacent repeats of a document form a passage, with its
offsets in the original text and where the first copies are.

Every repeated unit is removed, however short. `min_words` is a floor that leaves passages
which may recur by chance: those with fewer words in units of `UNIT_WORDS` words or more
(cells of tables and one-word lines do, however many stand together). Passages of
`LONG_WORDS` such words are counted apart.

The text is read once; what is grouped and joined is a row of a few numbers a unit. Groups
are pre-aggregated to one number (the least doc_id), so a unit that a third of all
documents share costs a row a task; only digests that occur more than once are joined
back, in a join whose large keys Spark splits.

Edge cases: null or empty texts and units without words are no units (and do not break a
passage). A null doc_id ranks last. Rows of one doc_id rank alike: among them only
repeats within a text count. Repeated rows are one text, and each gets its row. An empty
table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import common
from .decontaminate import WORD

MIN_WORDS, LONG_WORDS, UNIT_WORDS = 0, 25, 4
LAST = (1 << 63) - 1
END = re.compile(r"[.!?]+(?=\s)|\n")

UNITS = "rank long, row long, unit int, start int, end int, words int, d1 long, d2 long, again boolean"


def split(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each unit with words."""
    out, at = [], 0
    for stop in [m.end() for m in END.finditer(text)] + [len(text)]:
        piece = text[at:stop]
        if piece and (w := WORD.findall(piece.lower())):
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, at + len(piece.rstrip()), w))
        at = stop
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_of(text: str | None) -> int:
    """What F.xxhash64 gives for a text."""
    return signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)) if text is not None else 42


def units(docs: DataFrame) -> DataFrame:
    """UNITS of docs (doc_id, text); row is a hash of the text. Each row of docs has one of unit -1, with start units and words in all."""
    schema = StructType.fromDDL(UNITS)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def task(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                cols: list[list] = [[] for _ in kinds]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    row, seen, every = row_of(text), set(), split(text or "")
                    head = (LAST if doc is None else doc, row, -1, len(every), 0, sum(len(w) for *_, w in every), 0, 0, False)
                    for c, v in zip(cols, head, strict=True):
                        c.append(v)
                    for k, (start, end, w) in enumerate(every):
                        d = xxhash.xxh3_128_intdigest(" ".join(w).encode("utf-8", "surrogatepass"))
                        for c, v in zip(cols, (LAST if doc is None else doc, row, k, start, end, len(w), signed(d >> 64), signed(d & (1 << 64) - 1), d in seen), strict=True):
                            c.append(v)
                        seen.add(d)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, schema)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The passages to remove: doc_id, row, start, end, n_units, n_words, solid (words in units of UNIT_WORDS or more), kept_in (documents of the first copies)."""
    null = lambda c: F.when(c != LAST, c)
    found = passages(common.keep(units(docs), "units"), min_words)
    return found.select(null(F.col("rank")).alias("doc_id"), "row", "start", "end", "n_units", "n_words", "solid", F.transform("kept_in", null).alias("kept_in"))


def passages(every: DataFrame, min_words: int) -> DataFrame:
    """The same by rank, from stored units."""
    own = every.where("unit >= 0")
    # stored, so that the join has two plain inputs: the rows of one digest are split among tasks
    groups = common.keep(own.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    met = own.join(groups, ["d1", "d2"]).where((F.col("rank") > F.col("first")) | F.col("again"))
    met = met.dropDuplicates(["rank", "row", "unit"])
    by = Window.partitionBy("rank", "row").orderBy("unit")
    runs = met.withColumn("run", F.col("unit") - F.row_number().over(by))
    solid = F.sum(F.when(F.col("words") >= UNIT_WORDS, F.col("words")).otherwise(0))
    found = runs.groupBy("rank", "row", "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.count("*").alias("n_units"), F.sum("words").cast("long").alias("n_words"), solid.alias("solid"), F.array_sort(F.collect_set("first")).alias("kept_in"))
    return found.where(F.col("solid") >= min_words)


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with these passages cut out of text, and removed (removed_ if there is such a column, ...): their [start, end] in the original text."""
    name = "removed"
    while name in docs.columns:
        name += "_"
    cuts = repeats(docs, min_words).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "end")).alias("__cuts"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__row"))
    own = docs.join(cuts, same, "left").drop("__id", "__row")
    schema = StructType([*own.schema.fields[:-1], StructField(name, ArrayType(ArrayType(LongType())))])
    at = docs.columns.index("text")

    def task(batches):
        for b in batches:
            texts, removed = b.column(at).to_pylist(), []
            for i, of in enumerate(b.column(b.num_columns - 1).to_pylist()):
                mine = sorted((c["start"], c["end"]) for c in of or [])
                for s, e in reversed(mine):
                    texts[i] = texts[i][:s] + texts[i][e:]
                removed.append([list(c) for c in mine])
            columns = [*b.columns[:-1], pa.array(removed, pa.list_(pa.list_(pa.int64())))]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.record_batch(columns, names=schema.names)

    return own.mapInArrow(task, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """A row a document: units and words, how many of them are repeats, words of long passages, and all passages as start:end:document of the first copy."""
    every = common.keep(units(common.table(spark, sf_dir, "documents")), "units")
    n = lambda c: F.sum(c).cast("long")
    kept = F.array_min(F.filter("kept_in", lambda d: d != LAST))
    span = F.struct("start", F.concat_ws(":", F.col("start"), F.col("end"), F.coalesce(kept.cast("string"), F.lit("null"))).alias("as"))
    by = passages(every, MIN_WORDS).groupBy("rank", "row").agg(n("n_units").alias("n_repeats"), n("n_words").alias("repeat_words"), n(F.when(F.col("solid") >= LONG_WORDS, F.col("n_words")).otherwise(0)).alias("long_words"), F.array_sort(F.collect_list(span)).alias("s"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    heads = every.where("unit = -1").select("rank", "row", F.col("start").cast("long").alias("n_units"), F.col("words").cast("long").alias("n_words"))
    spans = F.coalesce(F.array_join(F.transform("s", lambda x: x["as"]), ","), F.lit("")).alias("spans")
    return heads.join(by, ["rank", "row"], "left").select(F.when(F.col("rank") != LAST, F.col("rank")).alias("doc_id"), "n_units", "n_words", none("n_repeats"), none("repeat_words"), none("long_words"), spans)


#: The same rows in DuckDB's SQL, for texts without the character U+0001.
OP6_SQL = r"""
with pieces as (
  select doc_id, md5(text) as row, unnest(p) as piece, unnest(range(1, len(p) + 1)) as k
  from (select doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?]+)(\s)', concat('\1', chr(1), '\2'), 'g'), '\n', concat(chr(10), chr(1)), 'g'), chr(1)) as p from documents where text <> '')
), placed as (
  select doc_id, row, k, piece, sum(length(piece)) over (partition by doc_id, row order by k rows unbounded preceding) - length(piece) as pos,
    regexp_extract_all(lower(piece), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select distinct * from pieces)
), units as (
  select doc_id, row, k, row_number() over (partition by doc_id, row order by k) as unit, len(w) as words, md5(array_to_string(w, ' ')) as digest,
    pos + length(piece) - length(regexp_replace(piece, '^\s+', '')) as a, pos + length(regexp_replace(piece, '\s+$', '')) as e
  from placed where len(w) > 0
), ranked as (
  select *, min(coalesce(doc_id, 9223372036854775807)) over (partition by digest) as first, row_number() over (partition by doc_id, row, digest order by unit) as nth from units
), runs as (
  select *, unit - row_number() over (partition by doc_id, row order by unit) as run from ranked where coalesce(doc_id, 9223372036854775807) > first or nth > 1
), found as (
  select doc_id, row, min(a) as a, count(*) as n, sum(words) as words, case when sum(case when words >= 4 then words else 0 end) >= 25 then sum(words) else 0 end as long_,
    concat(cast(min(a) as bigint), ':', cast(max(e) as bigint), ':', coalesce(cast(min(nullif(first, 9223372036854775807)) as varchar), 'null')) as span
  from runs group by doc_id, row, run
), by_text as (
  select coalesce(doc_id, 9223372036854775807) as id, row, sum(n) as n, sum(words) as words, sum(long_) as long_, string_agg(span, ',' order by a) as spans from found group by all
), sizes as (select coalesce(doc_id, 9223372036854775807) as id, row, count(*) as n, sum(words) as words from units group by all)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_units, cast(coalesce(s.words, 0) as bigint) as n_words, cast(coalesce(f.n, 0) as bigint) as n_repeats,
  cast(coalesce(f.words, 0) as bigint) as repeat_words, cast(coalesce(f.long_, 0) as bigint) as long_words, coalesce(f.spans, '') as spans
from documents d left join sizes s on s.id = coalesce(d.doc_id, 9223372036854775807) and s.row = md5(d.text)
left join by_text f on f.id = coalesce(d.doc_id, 9223372036854775807) and f.row = md5(d.text)
"""
