"""Mixing sources to target weights by min-cost flow (method 3).

Sources overlap where several hold a text. Texts with the same set of sources form a
pattern. Words flow from each pattern to its sources: the first copy of a pattern's words
costs 0 a word, the k-th costs ceil(log2 k) (convex repetition costs), whichever sources
take them; a source takes its quota, and from its documents of a pattern at most
`MAX_COPIES` times their words. So a source whose texts others hold too leaves these to
them where it can fill its quota otherwise.

The flow gives each source a number of words of each pattern. Of these documents all are
taken as often as fits, and once more the first ones of a seeded order until the words are
reached; the last is taken in part. First copies come before other copies of a text within
a source, and a pattern's sources start at different places of one circular order of its
texts, so that they take different ones.

What reaches the driver is a row for each set of sources that some text has, and source
in it, and one boundary row each. The flow is solved in time near linear in them
(route()). The boundary is found by sums over `BINS` ranges of the seeded hash and then
exactly within one range, so no task holds all documents of a hot source. Texts are told
apart by 128 bits of hash; counts are added up before texts are grouped, and only texts with
several rows are joined back, in a join of stored tables whose large keys Spark splits.

Edge cases: a null source is a source of its own, last in order. Null texts and those
without words have size 0 and nothing is taken. Equal rows (text, source, doc_id) at a
boundary share what is left in equal parts, so that up to a word less than their number may
be missing from the target. An empty table gives no rows. A null doc_id orders as the least
one.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, TOTAL, MAX_COPIES, BINS, SEED = (3, 1, 2), 1.5, 2, 4096, 7
LEAST, CIRCLE_BITS = -(1 << 63), 62
#: Rows of a table that is broadcast (a row has the sources of one text, or a boundary).
BROADCAST_ROWS = 10_000


def targets(sizes: dict, total: float = TOTAL, weights: tuple = WEIGHTS, cap: int = MAX_COPIES) -> dict:
    """Words for each source: shares of total * all words by weight; none above cap times its size.

    What a source can't take is shared by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = total * sum(sizes.values()), {}, list(order)
    while open_:
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


class Flow:
    """A largest flow from patterns to sources, kept while the patterns' supplies grow (Dinic's levels and current arcs).

    Patterns and sources are numbered; edge e goes from pattern ep[e] to source es[e], with flow ef[e] of at most em[e].
    """

    def __init__(self, edges: list[tuple[int, int, int]], patterns: int, need: list[int]) -> None:
        self.ep, self.es, self.em = (list(x) for x in zip(*edges, strict=True)) if edges else ([], [], [])
        self.ef = [0] * len(edges)
        self.need, self.supply = need, [0] * patterns
        self.of_pattern: list[list[int]] = [[] for _ in range(patterns)]
        self.of_source: list[list[int]] = [[] for _ in need]
        for e, (p, s, _) in enumerate(edges):
            self.of_pattern[p].append(e)
            self.of_source[s].append(e)

    def levels(self) -> bool:
        """Distances to a source in need, up to the nearest pattern with supply; whether there is one."""
        self.lp, self.ls = [0] * len(self.supply), [0] * len(self.need)
        front = [s for s, n in enumerate(self.need) if n]
        for s in front:
            self.ls[s] = 1
        depth, met = 1, False
        while front and not met:
            patterns = []
            for s in front:
                for e in self.of_source[s]:
                    p = self.ep[e]
                    if not self.lp[p] and self.ef[e] < self.em[e]:
                        self.lp[p] = depth + 1
                        patterns.append(p)
                        met = met or self.supply[p] > 0
            front = []
            for p in patterns:
                for e in self.of_pattern[p]:
                    s = self.es[e]
                    if not self.ls[s] and self.ef[e]:
                        self.ls[s] = depth + 2
                        front.append(s)
            depth += 2
        return met

    def block(self) -> None:
        """A blocking flow along the levels."""
        at_p, at_s = [0] * len(self.supply), [0] * len(self.need)
        ep, es, ef, em, lp, ls = self.ep, self.es, self.ef, self.em, self.lp, self.ls
        for start, have in enumerate(self.supply):
            path: list[int] = []  # edges to a source and back to a pattern, in turn
            while have and lp[start]:
                if len(path) % 2 == 0:
                    p = ep[path[-1]] if path else start
                    own, k = self.of_pattern[p], at_p[p]
                    while k < len(own) and not (ef[own[k]] < em[own[k]] and ls[es[own[k]]] == lp[p] - 1):
                        k += 1
                    at_p[p] = k
                    if k < len(own):
                        path.append(own[k])
                    elif path:
                        at_s[es[path.pop()]] += 1
                    else:
                        break
                elif self.need[s := es[path[-1]]]:
                    have = self.push(path, have)
                    path = []
                else:
                    own, k = self.of_source[s], at_s[s]
                    while k < len(own) and not (ef[own[k]] and 0 < lp[ep[own[k]]] == ls[s] - 1):
                        k += 1
                    at_s[s] = k
                    if k < len(own):
                        path.append(own[k])
                    else:
                        at_p[ep[path.pop()]] += 1
            self.supply[start] = have

    def push(self, path: list[int], have: int) -> int:
        """Send what the path takes; what is left of the start's supply."""
        end = self.es[path[-1]]
        n = min(have, self.need[end], *(self.em[e] - self.ef[e] if k % 2 == 0 else self.ef[e] for k, e in enumerate(path)))
        for k, e in enumerate(path):
            self.ef[e] += n if k % 2 == 0 else -n
        self.need[end] -= n
        return have - n

    def run(self) -> None:
        while self.levels():
            self.block()


def route(capacity: dict, members: dict[str, list], quota: dict, copies: int = MAX_COPIES, most: dict | None = None) -> dict[tuple, int]:
    """(pattern, source) -> words of a largest flow of least cost.

    capacity: words of one copy of a pattern. most: (pattern, source) -> most words on that
    edge; without it, no pattern gives more than `copies` copies in all.

    A path of least cost from the patterns to a source in need uses one step of one pattern's
    costs, as a path visits the start once. So successive shortest paths are a largest flow with
    each pattern's first copy, then one with its second as well, then with 4, 8, ...: a flow's
    patterns never get less again.
    """
    patterns, sources = sorted(members), sorted({s for ms in members.values() for s in ms}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    edges = [(i, number[s], copies * capacity[p] if most is None else most[p, s]) for i, p in enumerate(patterns) for s in members[p]]
    limit = [copies * capacity[p] if most is None else sum(most[p, s] for s in members[p]) for p in patterns]
    flow = Flow(edges, len(patterns), [quota[s] for s in sources])
    given, times = [0] * len(patterns), 1
    while any(flow.need) and any(g < m for g, m in zip(given, limit, strict=True)):
        for i, p in enumerate(patterns):
            now = min(limit[i], times * capacity[p])
            flow.supply[i] += now - given[i]
            given[i] = now
        flow.run()
        times *= 2
    return {(patterns[p], sources[s]): n for p, s, n in zip(flow.ep, flow.es, flow.ef, strict=True)}


def sized(docs: DataFrame, columns: dict[str, F.Column]) -> DataFrame:
    """The given columns, and doc_id, source, size (words of text), k1 and k2 (its hashes)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
    return docs.select(*[c.alias(k) for k, c in columns.items()], F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def shared_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of texts with words: patterns (p, words of one copy), and those with several rows: k1, k2, who."""
    own = rows.where("size > 0").groupBy("k1", "k2", "source").agg(F.first("size").alias("size"), F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(LEAST))).alias("first"))
    who = F.array_sort(F.collect_list(F.struct("source", "first")))  # a source each
    texts = common.keep(own.groupBy("k1", "k2").agg(F.first("size").alias("size"), F.sum("n").alias("n"), who.alias("who")), "texts")
    words = texts.groupBy(F.to_json(F.transform("who", lambda w: w["source"])).alias("p")).agg(F.sum("size").alias("words"))
    return words, texts.where("n > 1").select("k1", "k2", "who")


def placed(rows: DataFrame, groups: DataFrame, seed: int) -> DataFrame:
    """rows, with p (their text's sources), copy (1: not the first of its text in its source) and h (place on the circle).

    groups, if few, are broadcast.
    """
    of = groups.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "who")
    of = F.broadcast(of) if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else of
    met = rows.join(of, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")) & (F.col("size") > 0), "left")
    sources = F.coalesce(F.transform("who", lambda w: w["source"]), F.array("source"))
    first = F.filter("who", lambda w: w["source"].eqNullSafe(F.col("source")))[0]["first"]
    copy = F.coalesce((first != F.coalesce("doc_id", F.lit(LEAST))).cast("long"), F.lit(0).cast("long"))
    circle = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k1", "k2"), 64 - CIRCLE_BITS)
    return met.withColumns({"p": F.to_json(sources), "copy": copy, "h": circle}).drop("k1", "k2", "__k1", "__k2", "who")


def place() -> F.Column:
    """A row's place in the order of its pattern and source, which starts at `start` on the circle."""
    turned = F.pmod(F.col("h") - F.col("start"), F.lit(1 << CIRCLE_BITS))
    return F.struct("copy", turned.alias("h"), F.coalesce("doc_id", F.lit(LEAST)).alias("i"), F.col("size").alias("z"))


def plan(spread: DataFrame, words: DataFrame, **options) -> DataFrame:
    """One row a pattern and source in it: full (times each of its documents is taken) and the boundary of the rest.

    spread: placed(), stored, as it is read several times. words: the words of one copy of each pattern.
    """
    spark, cap = spread.sparkSession, options.get("cap", MAX_COPIES)
    capacity = {r.p: r.words for r in words.collect()}
    held: dict[tuple, int] = {}
    sizes: dict = defaultdict(int)
    for r in spread.groupBy("p", "source").agg(F.sum("size").alias("size")).collect():  # a row a pattern and source
        sizes[r.source] += r["size"]
        if r.p in capacity and r["size"]:
            held[r.p, r.source] = r["size"]
    members: dict[str, list] = defaultdict(list)
    for p, s in sorted(held, key=lambda k: (k[0], k[1] is None, k[1] or "")):
        members[p].append(s)
    goal = targets(sizes, **options)
    flow = route(capacity, members, {s: round(t) for s, t in goal.items()}, cap, {k: cap * n for k, n in held.items()})
    full, rest, start = {}, {}, {}
    for p, ms in members.items():
        before = 0
        for s in ms:
            n = flow[p, s]
            full[p, s], rest[p, s] = divmod(n, held[p, s])
            start[p, s] = (before << CIRCLE_BITS) // capacity[p] % (1 << CIRCLE_BITS)
            before += n

    bounds = {}
    some = [(p, s, start[p, s], n) for (p, s), n in rest.items() if n]
    if some:
        own = (F.col("p") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s"))
        binned = spread.join(small(spark, some, "__p string, __s string, start long, rest long"), own).where("size > 0").withColumn("at", place())
        binned = binned.withColumn("bin", F.col("copy") * BINS + F.shiftright(F.col("at.h"), CIRCLE_BITS - BINS.bit_length() + 1))
        by_bin = binned.groupBy("p", "source", "rest", "bin").agg(F.sum("size").alias("n")).withColumn("to", F.sum("n").over(Window.partitionBy("p", "source").orderBy("bin")))
        edge = [(r.p, r.source, r.bin, r.need) for r in by_bin.where("to >= rest and to - n < rest").select("p", "source", "bin", (F.col("rest") - F.col("to") + F.col("n")).alias("need")).collect()]
        near = binned.drop("rest", "__p", "__s").join(small(spark, edge, "__p string, __s string, __bin long, need long"), own & (F.col("bin") == F.col("__bin")))
        exact = near.groupBy("p", "source", "need", "at").agg(F.count("*").alias("rows")).withColumn("n", F.col("rows") * F.col("at.z")).withColumn("to", F.sum("n").over(Window.partitionBy("p", "source").orderBy("at")))
        for r in exact.where("to >= need and to - n < need").select("p", "source", "at", "rows", (F.col("need") - F.col("to") + F.col("n")).alias("left")).collect():
            bounds[r.p, r.source] = (tuple(r["at"]), r.left // r.rows)
    out = [(p, s, start.get((p, s), 0), full.get((p, s), 0), *bounds.get((p, s), (None, 0))) for p, s in held]
    planned = small(spark, out, "p string, s string, start long, full long, edge struct<copy:long,h:long,i:long,z:long>, part long")
    return planned, small(spark, [(s, n, goal[s]) for s, n in sizes.items()], "s string, source_size long, target double")


def small(spark, rows: list, schema: str) -> DataFrame:
    """A table of a row a pattern and source; broadcast while it is known to be small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def taken(spread: DataFrame, planned: DataFrame) -> DataFrame:
    """spread and taken: the words of each row that the mix takes."""
    of = planned.select(F.col("p").alias("__p"), F.col("s").alias("__s"), "start", "full", "edge", "part")
    rows = spread.join(of, (F.col("p") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    at = place()
    once = F.when(F.col("edge").isNull() | (F.col("size") == 0), 0).when(at < F.col("edge"), F.col("size")).when(at == F.col("edge"), F.col("part")).otherwise(0)
    return rows.withColumn("taken", F.coalesce(F.col("full") * F.col("size"), F.lit(0)) + once).drop("p", "h", "copy", "__p", "__s", "start", "full", "edge", "part")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix's rows, in docs' columns: whole documents, repeated as often as they are taken.

    A source is in "source". Of the document at a boundary the copy stays if half of it or more is taken.
    """
    light = common.keep(sized(docs, {}), "sizes")
    words, groups = shared_texts(light)
    planned, _ = plan(common.keep(placed(light, groups, seed), "places"), words, **options)
    whole = sized(docs, {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    copies = F.when(F.col("size") == 0, 0).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    out = taken(placed(whole, groups, seed), planned).where(copies > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), copies)))
    return out.select("row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    light = common.keep(sized(docs, {"__id": F.col("doc_id")}), "sizes")
    words, groups = shared_texts(light)
    spread = common.keep(placed(light, groups, SEED), "places")
    planned, sources = plan(spread, words)
    out = taken(spread, planned).join(sources, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", "taken")
