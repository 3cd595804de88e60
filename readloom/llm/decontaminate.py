"""Benchmark decontamination by a broadcast set of normalised n-grams (method 1).

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and characters from U+0080
on. A window is `n` consecutive words of a benchmark item, or the whole item if it
has fewer (and some). Windows are hashed; the hashes of a block of items, of at most
`block_windows` windows, go to every task; documents are scanned with rolling
hashes, and each hit is verified word by word. Beyond one block, one block at a time
is read, sent and scanned for, and what it hits is stored and merged by digest of the
text: driver and tasks hold one block (or one item, if that is larger). No shuffle with
one block.

Edge cases: null or empty texts (documents, items) have no words: no hits, not
contaminated. A null item_id is an item of its own, shown as "null". Repeated item
rows count once. Repeated document rows each get their own row. An empty benchmark
marks nothing. A hit document word counts once, however many windows cover it.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
LOWER = {i: i + 32 for i in range(65, 91)}
N, BLOCK_WINDOWS = 13, 2_000_000
SHARE = 20  # contaminated: at least one word in so many is hit


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


class Index:
    """The windows of some items: by length, sorted hashes and, for each, the item and place that it comes from.

    The words of an item are held once, so a window takes 16 bytes beside them.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], n: int) -> None:
        self.names: list[str | None] = []
        self.words: list[list[str]] = []
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        hashes, known = common.HashOf(), {}
        for name, w in {(i, tuple(words(t))): None for i, t in items}:  # repeated rows count once
            if w:
                k = min(n, len(w))
                by.setdefault(k, []).append((common.windows(hashes.array(list(w)), k), len(self.words)))
                self.names.append(name)
                self.words.append([known.setdefault(x, x) for x in w])
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, some in by.items():
            h = np.concatenate([x for x, _ in some])
            item = np.repeat(np.array([i for _, i in some], np.int32), [len(x) for x, _ in some])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in some])
            order = np.argsort(h, kind="stable")
            self.of[k] = (h[order], item[order], at[order])

    def scan(self, w: list[str], h: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        """The (first, end) words of each verified occurrence, and the items hit."""
        hits, items = [], set()
        for k, (keys, item, place) in self.of.items():
            x = common.windows(h, k)
            lo = np.searchsorted(keys, x)
            for i in np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == x).tolist():
                here, found = w[i : i + k], False
                for j in range(int(lo[i]), int(np.searchsorted(keys, x[i], side="right"))):
                    of, at = int(item[j]), int(place[j])
                    if self.words[of][at : at + k] == here:
                        items.add(self.names[of])
                        found = True
                if found:
                    hits.append((i, i + k))
        return hits, items


def named(items: set[str | None]) -> list[str | None]:
    """Items in order of their ids as strings; a null id, shown as "null", is an item of its own."""
    return sorted(items, key=lambda i: ("null", 1) if i is None else (i, 0))


FOUND = "n_words long, hits array<struct<first:long,end:long>>, items array<string>"


def scanned(docs: DataFrame, shared: Broadcast, columns: list[str]) -> DataFrame:
    """The given columns of docs, then FOUND, by a broadcast Index. Rows stay where they are."""
    keep = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))
    schema = StructType(keep.schema.fields[:-1] + StructType.fromDDL(FOUND).fields)
    hit = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def task(batches):
        ix, hashes = shared.value, common.HashOf()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                n, hits, items = [], [], []
                for text in b.column(b.num_columns - 1).to_pylist():
                    w = WORD.findall(lowered(text)) if text else []
                    found, ids = ix.scan(w, hashes.array(w)) if w else ([], set())
                    n.append(len(w))
                    hits.append([{"first": a, "end": e} for a, e in found])
                    items.append(named(ids))
                yield pa.record_batch([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(hits, hit), pa.array(items, pa.list_(pa.string()))], names=[f.name for f in schema.fields])

    return keep.mapInArrow(task, schema)


def blocks(benchmark: DataFrame, n: int, block_windows: int):
    """Lists of (item, text), each of at most block_windows windows or one item, one after another."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    some, size = [], 0
    for r in items.toLocalIterator():
        k = len(r.t) // 2 + 1  # no text has more words than that
        if some and size + k > block_windows:
            yield some
            some, size = [], 0
        some.append((r.i, r.t))
        size += k
    yield some


def first_blocks(benchmark: DataFrame, n: int, block_windows: int) -> list[list]:
    """The only block, or the first two."""
    return list(itertools.islice(blocks(benchmark, n, block_windows), 2))


def digest() -> F.Column:
    return F.sha2(F.col("text").cast("string"), 256)


def hit_texts(docs: DataFrame, benchmark: DataFrame, n: int, block_windows: int) -> DataFrame:
    """__digest, n_words, hits and items of each distinct text that any block hits, stored.

    One block at a time is built, sent and scanned for; then its place is free for the next.
    """
    spark, found = docs.sparkSession, None
    texts = docs.where("text is not null").select("text", digest().alias("__digest"))
    for block in blocks(benchmark, n, block_windows):
        shared = spark.sparkContext.broadcast(Index(block, n))
        some = scanned(texts, shared, ["__digest"]).where("size(hits) > 0")
        some = common.keep(some.groupBy("__digest").agg(*[F.first(c).alias(c) for c in ("n_words", "hits", "items")]), "hits")
        shared.unpersist()
        found = some if found is None else found.unionByName(some)
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # a list a block
    merged = found.groupBy("__digest").agg(F.first("n_words").alias("n_words"), every("hits").alias("hits"), every("items").alias("items"))
    in_order = F.transform(F.array_sort(F.transform("items", lambda i: F.struct(F.coalesce(i, F.lit("null")).alias("a"), i.isNull().alias("b"), i.alias("c")))), lambda x: x["c"])
    return common.keep(merged.withColumn("items", in_order), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str], n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The given columns of each row of docs, and n_words, hits (word ranges) and items.

    With more than one block, what is hit is found for each distinct text and joined to the rows.
    """
    first = first_blocks(benchmark, n, block_windows)
    if len(first) == 1:
        return scanned(docs, docs.sparkSession.sparkContext.broadcast(Index(first[0], n)), columns)
    found = hit_texts(docs, benchmark, n, block_windows).drop("n_words")
    n_words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(ANY_WORD)), F.lit(0)).cast("long")
    own = docs.select(*[F.col(f"`{c}`") for c in columns], n_words.alias("n_words"), digest().alias("__digest"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(found.dtypes)[c])).alias(c)
    return own.join(found, "__digest", "left").select(*[F.col(f"`{c}`") for c in [*columns, "n_words"]], empty("hits"), empty("items"))


def hit_words() -> F.Column:
    """How many words some hit covers: hits by start, each counted from where those before end."""
    step = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), h["end"] - F.greatest(a["to"], h["first"]))).alias("n"), F.greatest(a["to"], h["end"]).alias("to")),
    )
    return step["n"]


def judged(docs: DataFrame, benchmark: DataFrame, columns: list[str], **options) -> DataFrame:
    """contamination(), with n_hit and contaminated."""
    seen = contamination(docs, benchmark, columns, **options).withColumn("n_hit", hit_words())
    return seen.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def covered(n_words: int, hits: list[tuple[int, int]]) -> np.ndarray:
    """Which words some hit covers."""
    mark = np.zeros(n_words, bool)
    for a, e in hits:
        mark[a:e] = True
    return mark


def without(text: str, mark: np.ndarray) -> str:
    """text without each run of marked words, what stays joined by a space."""
    spots = list(WORD.finditer(lowered(text)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
    at, out = 0, []
    for a, e in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : spots[a].start()])
        at = spots[e - 1].end()
    return " ".join(x.strip() for x in [*out, text[at:]] if x.strip())


def goes(hits: list[tuple[int, int]], n_words: int, n_hit: int, rule: str, n: int) -> bool:
    """Whether a document goes: a share of SHARE of its words or more is hit, or (rule "windows") any window of n words."""
    return bool(hits) and (SHARE * n_hit >= n_words or rule == "windows" and any(e - a == n for a, e in hits))


#: remove -> (rule by which rows go, whether hit words are cut out of the others)
WAYS = {"documents": ("share", False), "windows": ("windows", False), "spans": (None, True), "both": ("share", True)}


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without what the benchmark holds, in docs' own columns.

    remove="documents": contaminated rows go. remove="windows": rows that hold any window of n
    words go, and contaminated ones (of items with fewer words than n). remove="spans": every
    hit word goes, from the start of a run of hit words to its end, and what stays is joined by
    a space; rows stay. remove="both": contaminated rows go, and the hit words of the others.

    Cutting is repeated until nothing is hit, as a cut can bring the words of a window together;
    each turn cuts what all items hit, so that the size of blocks does not matter. n_chars, if
    there is one, follows a text that was cut.
    """
    rule, cuts = WAYS[remove]
    first = first_blocks(benchmark, n, block_windows)
    if len(first) == 1:
        return cleaned(docs, first[0], rule, cuts, n)
    found = hit_texts(docs, benchmark, n, block_windows)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if rule:
        bad = SHARE * hit_words() >= F.col("n_words")
        if rule == "windows":
            bad = bad | F.exists("hits", lambda h: h["end"] - h["first"] == n)
        docs = docs.withColumn("__digest", digest()).join(found.where(bad).select("__digest"), "__digest", "left_anti").select(*names)
        found = found.where(~bad)
    while cuts and not found.isEmpty():
        marked = docs.withColumn("__digest", digest()).join(found.select("__digest", F.col("hits").alias("__hits")), "__digest", "left").drop("__digest")
        docs = common.keep(marked.mapInArrow(cutting(docs.columns), docs.schema), "cut")
        found = hit_texts(docs, benchmark, n, block_windows)
    return docs


def cutting(columns: list[str]):
    """A task that cuts the words in the last column, hits, out of text and leaves that column out."""
    at, size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def task(batches):
        for b in batches:
            hits = b.column(b.num_columns - 1)
            own = b.select(list(range(b.num_columns - 1)))
            some = pc.indices_nonzero(hits.is_valid()).to_pylist()
            yield replaced(own, at, size, {i: without(t := own.column(at)[i].as_py(), covered(len(words(t)), [(h["first"], h["end"]) for h in hits[i].as_py()])) for i in some})

    return task


def replaced(b: pa.RecordBatch, at: int, size: int | None, texts: dict[int, str]) -> pa.RecordBatch:
    """b with these texts, by row, in column at, and their lengths in column size."""
    for c, new in ((at, texts), (size, {i: len(t) for i, t in texts.items()})):
        if c is not None and new:
            values = b.column(c).to_pylist()
            for i, v in new.items():
                values[i] = v
            b = b.set_column(c, b.schema.field(c), pa.array(values, b.schema.field(c).type))
    return b


def cleaned(docs: DataFrame, items: list, rule: str | None, cuts: bool, n: int) -> DataFrame:
    """clean() with all items in one Index: rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, n))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def task(batches):
        ix, hashes = shared.value, common.HashOf()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                stay, new = np.ones(b.num_rows, bool), {}
                for i, text in enumerate(b.column(at).to_pylist()):
                    turn = 0
                    while text:
                        w = WORD.findall(lowered(text))
                        hits = ix.scan(w, hashes.array(w))[0] if w else []
                        if not hits:
                            break
                        mark = covered(len(w), hits)
                        if not turn and rule and goes(hits, len(w), int(mark.sum()), rule, n):
                            stay[i] = False
                            break
                        if not cuts:
                            break
                        text, turn = without(text, mark), turn + 1
                        new[i] = text
                yield replaced(b, at, size, new).filter(pa.array(stay))

    return docs.mapInArrow(task, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    seen = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return seen.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",", "null"), 256).alias("items_sha256"), "contaminated")


#: The same rows in DuckDB's SQL.
OP1_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), iw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), items as (
  select distinct item, len(w) as k0, least(13, len(w)) as k, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p from iw where len(w) > 0)
), sizes as (select distinct k from items
), dwin as (
  select doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, sizes where len(w) >= k)
), hit as (select d.doc_id, d.p, d.k, i.item from dwin d join items i on d.win = i.win and d.k = i.k
), covered as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hit) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id
)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered using (doc_id) left join named using (doc_id)
"""
