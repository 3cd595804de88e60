"""n-gram Jaccard join with Bayesian candidate pruning (method 9).

Texts are compared by their sets of shingles of five consecutive lower-cased words (a
shorter text: all its words, as one). Rows with one set of shingles form a class, and
classes are linked if their Jaccard similarity is `THRESHOLD` or more.

1. One pass gives each row a 128-bit digest of its set and `HASHES` MinHash values.
2. Classes (one row each, copies counted) are put into buckets by bands of MinHash values.
   At the threshold a pair misses all of the 24 bands with probability 3e-6.
3. In a bucket, pairs are compared by a few MinHash values at a time; a pair is dropped as
   soon as the posterior probability that it reaches the threshold (uniform prior) is
   below `TOLERANCE`. A bucket over `BUCKET_BLOCK` classes is cut into blocks by hash, and
   each pair of blocks is a task's group. A group of more than `SMALL` gives an edge from each member to the
   least of its tree, and pairs that a tree already joins are passed over, so a bucket of
   near copies costs few comparisons more than it has members, and no node many edges.
4. Connected components of that (alternating stars; tables, nothing on the driver) hold
   all links. Within a component, again by pairs of blocks, exact Jaccard similarities
   of all pairs give each class's number of links and the trees of the links.
5. Components of the links are the near-duplicate classes.

Class keys are 64 bits of the digest; the other 64 are checked, and on a collision all is
made anew with another seed.

Edge cases: null, empty or wordless texts have no shingles, link with nothing and are each
a class of their own row. Repeated rows are copies. A null doc_id is allowed and never
becomes a class_id unless all of a class have none. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import WORD

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 24, 4
HASHES, STEP = BANDS * ROWS, 16
#: Classes of a bucket, and classes and shingles of a component, that one task compares with as many others.
BUCKET_BLOCK, BLOCK, BLOCK_SHINGLES = 512, 256, 1_000_000
COLUMNS, SMALL = 8192, 12


def shingles(text: str | None, hashes: common.HashOf, seed: int = 0) -> np.ndarray:
    """The sorted set of shingles, as 64-bit hashes."""
    words = WORD.findall(text.lower()) if text else []
    h = hashes.array(words)
    return np.unique(common.windows(h, min(SHINGLE, len(words))) ^ np.uint64(seed)) if words else h


def multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 32, HASHES, np.uint32) | np.uint32(1)


def signature(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1 << 15):
        np.minimum(low, np.multiply.outer(by, x[at : at + (1 << 15)]).min(1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_matches(t: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values compared: the fewest matches m at which P(J >= t | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m+1, n-m+1), so P = P(Binomial(n+1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and text: with doc_id, th leads from a row's features back to it."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


FEATURES = "doc_id long, th long, node long, rest long, n long, sig binary"


def features(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, a hash of the text, the class key (two halves), the number of shingles and MinHash values of each row."""

    def task(batches):
        hashes, by = common.HashOf(), multipliers()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                node, rest, n, sig = [], [], [], []
                for text in b.column(2).to_pylist():
                    x = shingles(text, hashes, seed)
                    d = xxhash.xxh128_digest(x.tobytes(), seed)
                    node.append(int.from_bytes(d[:8], "little", signed=True))
                    rest.append(int.from_bytes(d[8:], "little", signed=True))
                    n.append(len(x))
                    sig.append(signature(x, by).tobytes() if len(x) else b"")
                yield pa.record_batch([b.column(0), b.column(1), *(pa.array(v, pa.int64()) for v in (node, rest, n)), pa.array(sig, pa.binary())], names=["doc_id", "th", "node", "rest", "n", "sig"])

    return texts_of(docs).mapInArrow(task, FEATURES)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the first `keys` (long) columns, from sorted batches, and where groups start."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for b in batches:
        held.append(b)
        t = pa.Table.from_batches(held)
        at = edges(t)
        if len(at) > 1:
            yield t.slice(0, int(at[-1])), at[:-1]
            held = t.slice(int(at[-1])).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, edges(t)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def stars(pairs: tuple[np.ndarray, np.ndarray], nodes: list[int]) -> list[tuple[int, int]]:
    """(node, least node of its tree) for the trees that the pairs, places in the sorted nodes, make: no node has many edges to lesser ones."""
    f = Forest(len(nodes))
    for i, j in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        f.join(i, j)
    return [(nodes[i], nodes[r]) for i in range(len(nodes)) if (r := f.root(i)) != i]


def likely(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (i, j) of rows of sig are never dropped."""
    live, m = np.arange(len(i)), np.zeros(len(i), np.int32)
    for n, need in least.items():
        part = slice(n - STEP, n)
        m += (sig[i[live], part] == sig[j[live], part]).sum(1, dtype=np.int32)
        stay = m >= need
        live, m = live[stay], m[stay]
        if not len(live):
            break
    return live


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the pairs left by Bayesian pruning connect; a large group gives one from each node to the least of its tree."""

    def band(batches):
        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(common.STEP)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
            key = common.mix((common.mix(sig.ravel()).reshape(sig.shape) + salt).ravel())
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "node"])

    some = classes.where("n > 0").select("node", "sig")
    bands = common.keep(some.mapInArrow(band, "key long, node long"), "bands")
    # stored, so that the join has two plain inputs: the rows of one bucket are split among tasks
    full = common.keep(bands.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "full")
    met = dealt(bands.join(full, "key"), "key", F.ceil(F.col("rows") / BUCKET_BLOCK), "node")
    ready = met.join(some, "node").select("key", "pair", "block", "node", "sig")
    least = least_matches()

    def compare(batches):
        for t, at in grouped(batches, 2):
            node, block = t.column(3).to_numpy(), t.column(2).to_numpy()
            first, second = t.column(1).to_numpy() >> 32, t.column(1).to_numpy() & 0xFFFFFFFF
            sig = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint16).reshape(-1, HASHES)
            sizes = np.diff(np.append(at, t.num_rows))
            a, b = [], []
            for s in np.unique(sizes[sizes <= SMALL]):  # small groups of one size together
                i, j = np.triu_indices(s, 1)
                starts = at[sizes == s]
                for k in range(0, len(starts), 4096):
                    x, y = ((starts[k : k + 4096, None] + v).ravel() for v in (i, j))
                    x, y = x[ok := wanted(x, y, block, first, second)], y[ok]
                    live = likely(sig, x, y, least)
                    a.append(node[x[live]])
                    b.append(node[y[live]])
            for lo, s in zip(at[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                tree = np.arange(s)  # members of one tree need not be compared
                for i in range(s - 1):
                    y = lo + i + 1 + np.flatnonzero(tree[i + 1 :] != tree[i])
                    if not len(y):
                        continue
                    x = np.full(len(y), lo + i)
                    x, y = x[ok := wanted(x, y, block, first, second)], y[ok]
                    near = y[likely(sig, x, y, least)] - lo
                    tree[np.isin(tree, tree[near])] = tree[i]
                of = node[lo : lo + s]
                top = np.full(s, np.iinfo(np.int64).max)
                np.minimum.at(top, tree, of)
                low = top[tree]
                a.append(of[of != low])
                b.append(low[of != low])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return ready.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(compare, "a long, b long").distinct()


def wanted(x, y, block, first, second) -> np.ndarray:
    """Pairs of this group: across its two blocks, or within it if both are one."""
    return (block[x] != block[y]) | (first[x] == second[x])


def dealt(rows: DataFrame, key: str, blocks: F.Column, by: str) -> DataFrame:
    """rows with block and pair (two block numbers in a long): each row once for every pair of blocks that holds it.

    A group of up to 256 blocks * BLOCK members costs as many copies of a row as it has blocks.
    """
    g = rows.withColumn("__g", F.greatest(F.lit(1), blocks.cast("int")))
    g = g.withColumn("block", F.pmod(F.xxhash64(F.lit(11), by), "__g").cast("long"))
    g = g.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__g").cast("long") - 1)))
    return g.withColumn("pair", F.shiftleft(F.least("block", "__o"), 32) + F.greatest("block", "__o")).drop("__g", "__o")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component, from edges (a, b).

    Alternating large and small stars; the edges are stored after each round, and rounds
    end when a round changes nothing.
    """
    e = common.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join has two plain inputs: a node with very many greater neighbours is split among tasks
        low = common.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")), "least")
        large = e.join(low, "b").select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e = common.keep(small.where("a <> b"), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(labels.select("label", "label").distinct())


def sets_of(members: DataFrame, seed: int) -> DataFrame:
    """label, node and set (its shingles, 8 bytes each) from (label, node, text): each text is cut once, before it is dealt out."""

    def task(batches):
        hashes = common.HashOf()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = [shingles(text, hashes, seed) for text in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "node", "set"])

    return members.select("label", "node", "text").mapInArrow(task, "label long, node long, set binary")


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """From stored (label, node, n) and their sets: rows (a, b, links): b null: links of class a; else an edge to the least node of a tree of links."""
    sums = common.keep(members.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("all")), "sums")
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("all") / BLOCK_SHINGLES))
    ready = dealt(sets.join(sums, "label"), "label", blocks, "node").select("label", "pair", "block", "node", "set")

    def task(batches):
        for t, at in grouped(batches, 2):
            a, b, links = [], [], []
            for lo, hi in zip(at, np.append(at[1:], t.num_rows), strict=True):
                part = t.slice(int(lo), int(hi - lo))
                pair = part.column(1)[0].as_py()
                seen = {node: (block, np.frombuffer(x, np.uint64)) for block, node, x in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)}
                nodes = sorted(seen)
                hit = similar([seen[k][1] for k in nodes])
                if pair >> 32 != pair & 0xFFFFFFFF:
                    block = np.array([seen[k][0] for k in nodes])
                    hit &= block[:, None] != block[None, :]
                for k, n in zip(nodes, hit.sum(1).tolist(), strict=True):
                    a.append(k)
                    b.append(None)
                    links.append(n)
                for i, j in stars(np.nonzero(np.triu(hit, 1)), nodes):
                    a.append(i)
                    b.append(j)
                    links.append(0)
            yield pa.record_batch([pa.array(v, pa.int64()) for v in (a, b, links)], names=["a", "b", "links"])

    return ready.repartition("label", "pair").sortWithinPartitions("label", "pair").mapInArrow(task, "a long, b long, links long")


def similar(sets: list[np.ndarray], t: float = THRESHOLD) -> np.ndarray:
    """Which sets have a Jaccard similarity of t or more: exact, by products of 0/1 matrices of COLUMNS shingles at a time."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    common_ = np.zeros((n, n))
    if n > 1:
        every = np.concatenate(sets)
        row = np.repeat(np.arange(n), sizes.astype(int))
        order = np.argsort(every, kind="stable")
        every, row = every[order], row[order]
        col = np.cumsum(np.concatenate(([0], every[1:] != every[:-1])))
        shared = np.bincount(col)[col] > 1
        col, row = np.unique(col[shared], return_inverse=True)[1], row[shared]
        width = int(col[-1]) + 1 if len(col) else 0
        for at in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(col, (at, at + COLUMNS))
            m = np.zeros((n, min(COLUMNS, width - at)), np.float32)
            m[row[lo:hi], col[lo:hi] - at] = 1
            common_ += m @ m.T
    either = sizes[:, None] + sizes[None, :] - common_
    out = common_ >= t * either - 1e-9
    np.fill_diagonal(out, False)
    return out & (common_ > 0)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row a class: node, doc_id (the least) and th of a row with it, rows, n, sig, and whether its key is of one class alone."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    by = rows.groupBy("node").agg(least, F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"), (F.min("rest") != F.max("rest")).alias("mixed"))
    return by.select("node", "least.doc_id", "least.th", "rows", "n", "sig", "mixed")


def join(docs: DataFrame) -> DataFrame:
    """A row for each of docs, stored: doc_id, th, class_id, n_links, copies, stays.

    class_id: the least doc_id of all near copies; n_links: other texts (classes) linked with
    this one; copies: other rows with the same shingles; stays: the row has the least (doc_id,
    th) of all near copies, nulls last, or no words.
    """
    seed = 0
    while True:
        rows = common.keep(features(docs, seed), "features")
        classes = common.keep(classes_of(rows), "classes")
        if classes.where("mixed").isEmpty():
            break
        seed += 1
    near = components(candidates(classes))
    members = common.keep(near.join(classes.select("node", "n", "doc_id", "th"), "node").select("label", "node", "n", F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "members")
    text = texts_of(docs)
    # merged at every size, as the members grow with the documents
    met = text.join(members.hint("merge"), F.col("__id").eqNullSafe(text.doc_id) & (F.col("__th") == text.th)).select("label", "node", "text")
    if not rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        met = met.dropDuplicates(["node"])  # equal rows
    found = common.keep(verified(members, sets_of(met, seed)), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    labels = components(found.where("b is not null").select("a", "b"))
    linked = labels.join(classes.select("node", "doc_id", "th"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    least = linked.groupBy("label").agg(first.alias("least"))
    result = labels.join(least, "label").join(links, "node").select("node", F.col("least.doc_id").alias("class_id"), "n_links", F.struct("least.doc_id", "least.th").alias("one"))
    own = classes.select("node", F.struct("doc_id", "th").alias("own"), F.col("rows"))
    result = own.join(result, "node", "left").select("node", F.coalesce("one", "own").alias("one"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("copies"))
    # stored, so that the join has two plain inputs: the rows of one class are split among tasks
    some = rows.where("n > 0").select("doc_id", "th", "node").join(common.keep(result, "classes"), "node")
    some = some.select("doc_id", "th", F.col("one.doc_id").alias("class_id"), "n_links", "copies", (F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("th") == F.col("one.th"))).alias("stays"))
    none = rows.where("n = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("stays"))
    return some.union(none)


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs, in its own columns, with one row of each near-duplicate class: that of least (doc_id, hash of the text).

    Rows without words stay. Of equal rows with that doc_id and text one stays.
    """
    stay = join(docs).where("stays").groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.max("copies").alias("copies"))
    stay = common.keep(stay.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), ((F.col("n") > 1) & (F.col("copies") > 0)).alias("__many")), "stay")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__th"))
    many = stay.where("__many")
    if many.isEmpty():
        return docs.join(stay, own, "left_semi")
    once = docs.join(stay.where(~F.col("__many")), own, "left_semi")
    one = docs.join(many, own, "left_semi").withColumn("__th", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "__th"])
    return once.union(one.drop("__th"))


def op9(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).drop("th", "stays")


#: doc_id, class_id, n_links and copies in DuckDB's SQL, by comparing all sets that share a shingle.
OP9_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as p from words where len(w) > 0)
), digests as (
  select doc_id, md5(string_agg(s, '|' order by s)) as node from shingles group by doc_id
), classes as (
  select node, min(doc_id) as id, count(*) as n_rows from digests group by node
), sets as (
  select c.id, x.s from classes c join shingles x on x.doc_id = c.id
), sizes as (
  select id, count(*) as n from sets group by id
), links as (
  select a, b from (select x.id as a, y.id as b, count(*) as both_ from sets x join sets y on x.s = y.s and x.id <> y.id group by x.id, y.id)
  join sizes p on p.id = a join sizes q on q.id = b where both_ >= 0.8 * (p.n + q.n - both_) - 1e-9
), reach as (
  select id as a, id as b from classes
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), least_ as (select a, min(b) as class_id from reach group by a
), degree as (select a, count(*) as n_links from links group by a)
select w.doc_id, coalesce(l.class_id, w.doc_id) as class_id, cast(coalesce(d.n_links, 0) as bigint) as n_links, cast(coalesce(c.n_rows - 1, 0) as bigint) as copies
from words w left join digests g on g.doc_id = w.doc_id left join classes c on c.node = g.node left join least_ l on l.a = c.id left join degree d on d.a = c.id
"""
