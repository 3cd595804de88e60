"""Language identification by cross-parsing entropy (method 5).

For each language a suffix automaton of labelled text is built. A text is parsed
greedily into the longest pieces that occur in that language's text; the language
that needs fewest pieces, times log2 of its training length, wins (ties: first by
code point). Texts are lower-cased, and what is between letters counts as one space.

Whole texts are parsed, in stretches of `STRETCH` characters which all start at the
automaton's root, and numpy moves all stretches and languages of a batch by a character
at once. The automata's edges are in one hash table, so memory follows the training text
and not the alphabet.

Training takes a bounded number of rows, whole: for each language `docs_per_language`
of those with least hash of doc_id, preferring texts of up to `LONGEST` characters. The
automata are built on the driver and broadcast: 20 rows of 2,000 characters in four
languages have about 0.3 million edges in 16 MB, a sum that grows with the texts of the
sample alone. The limit is one of rows; texts are learned from as they are.

Edge cases: null text or one without a letter is "und" with score 0. Rows without a
label or without a letter aren't learned from. No labels at all: everything is "und". A
null doc_id is not held out. Repeated rows each get their row, and may each be learned from.
"""

from __future__ import annotations

import math
import random
import re
import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

DOCS_PER_LANGUAGE, LONGEST, SPARE = 20, 20_000, 4
STRETCH, SLICE_CHARS = 1024, 1_500_000
LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> str:
    """Letters in lower case, with single spaces between them."""
    return " ".join(LETTERS.findall(text)).lower() if text else ""


class SuffixAutomaton:
    """Every substring of a sequence of small integers is a path from state 0."""

    def __init__(self, codes: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
            last = cur


def units(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Edges:
    """A hash table from keys to values in numpy: open addressing, linear probing, a third full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, most: int) -> None:
        """most: above all keys and values. 32-bit numbers serve while they reach."""
        small = most < (1 << 32) - 1
        self.kind = np.uint32 if small else np.uint64
        self.multiplier = self.kind(0x9E3779B1 if small else 0x9E3779B97F4A7C15)
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask, self.none = self.kind((32 if small else 64) - bits), (1 << bits) - 1, self.kind((1 << (32 if small else 64)) - 1)
        self.keys, self.values = np.full(1 << bits, self.none, self.kind), np.full(1 << bits, self.none, self.kind)
        keys, values = keys.astype(self.kind), values.astype(self.kind)
        slot = self.slots(keys)
        while len(keys):
            free = self.keys[slot] == self.none
            self.keys[slot[free]] = keys[free]  # of several for one place the last stays
            self.values[slot[free]] = values[free]
            rest = self.keys[slot] != keys
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.multiplier) >> self.shift).astype(np.intp)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values; `none` where there is no such key."""
        slot = self.slots(keys)
        there, out = self.keys[slot], self.values[slot]
        on = np.flatnonzero(there != keys)
        out[on] = self.none
        on = on[there[on] != self.none]
        slot, keys = slot[on], keys[on]
        while len(on):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            same = there == keys
            out[on[same]] = self.values[slot[same]]
            more = np.flatnonzero(~same & (there != self.none))
            on, slot, keys = on[more], slot[more], keys[more]
        return out


class Model:
    """The languages' automata, their edges in one table."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        joined = {k: "\n".join(texts[k]) for k in self.languages}
        letters = sorted(set().union(*joined.values()) - {"\n"})
        #: 0: a character of no language; it ends a piece and starts none.
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = width = len(letters) + 1
        #: the state after a piece that starts with a letter, by language; states are counted in steps of width
        self.roots = np.zeros((len(self.languages), width), np.int64)
        keys, values, base = [], [], 0
        for i, k in enumerate(self.languages):
            codes = self.code[units(joined[k])]
            codes[units(joined[k]) == ord("\n")] = -1
            of = SuffixAutomaton(codes.tolist()).next
            n = sum(map(len, of))
            state = np.repeat(np.arange(len(of)), np.fromiter(map(len, of), np.int64, len(of)))
            letter = np.fromiter((c for moves in of for c in moves), np.int64, n)
            to = (np.fromiter((t for moves in of for t in moves.values()), np.int64, n) + base) * width
            real = letter > 0
            keys.append(((state + base) * width + letter)[real])
            values.append(to[real])
            self.roots[i] = base * width
            first = real & (state == 0)
            self.roots[i, letter[first]] = to[first]
            base += len(of)
        self.edges = Edges(np.concatenate(keys), np.concatenate(values), base * width) if keys else None
        self.roots = self.roots.astype(self.edges.kind) if keys else self.roots
        self.bits = np.array([math.log2(max(2, len(joined[k]))) for k in self.languages])

    def pieces(self, texts: list[str]) -> np.ndarray:
        """texts x languages: how many pieces each text needs."""
        n, out = len(self.languages), np.zeros((len(texts), len(self.languages)), np.int64)
        spans = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), STRETCH)]
        if not spans or not n:
            return out
        sizes = np.array([min(STRETCH, len(texts[i]) - at) for i, at in spans])
        order = np.argsort(-sizes, kind="stable")
        codes = np.zeros((int(sizes.max()), len(spans)), self.edges.kind)
        for col, k in enumerate(order):
            i, at = spans[k]
            x = self.code[units(texts[i][at : at + STRETCH])]
            codes[: len(x), col] = x
        sizes = sizes[order]
        live = np.searchsorted(-sizes, -np.arange(len(codes)), side="left")  # columns longer than t
        state, count = np.repeat(self.roots[:, :1], len(spans), 1), np.ones((n, len(spans)), np.int32)
        for t, k in enumerate(live.tolist()):
            c = codes[t, :k]
            to = self.edges.find((state[:, :k] + c).ravel())
            ends = np.flatnonzero(to == self.edges.none)
            language, col = np.divmod(ends, k)
            to[ends] = self.roots[language, c[col]]
            count[language, col] += 1
            state[:, :k] = to.reshape(n, k)
        np.add.at(out, np.array([spans[k][0] for k in order]), count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and bits per character of each text.

        score: how much shorter the best parse is than the second best (0: equal).
        """
        norm = [plain(t) for t in texts]
        got: list[np.ndarray] = []
        at = size = 0
        for i, t in enumerate([*norm, None]):
            if t is None or size > SLICE_CHARS:
                got.append(self.pieces(norm[at:i]))
                at, size = i, 0
            size += len(t or "")
        cost = np.concatenate(got) * self.bits if self.languages else np.zeros((len(norm), 0))
        best = cost.argmin(1) if self.languages else None
        low = np.sort(cost, 1)
        names, scores, bits = [], [], []
        for i, t in enumerate(norm):
            known = best is not None and any(map(str.isalpha, t))  # number signs such as U+00B2 aren't letters
            names.append(self.languages[best[i]] if known else "und")
            scores.append(float(1 - low[i, 0] / low[i, 1]) if known and len(self.languages) > 1 else float(known))
            bits.append(float(low[i, 0] / len(t)) if known else 0.0)
        return names, scores, bits


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict[str, list[str]]:
    """Texts by language, from columns doc_id, text, lang: whole texts of a bounded number of rows.

    A count by language gives the hash below which SPARE times as many rows are expected as are
    wanted; only these are ordered, so that no task gets rows from every other task at scale.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    place = F.shiftrightunsigned(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), 2)  # 62 bits
    counts = {r.lang: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spare, got = SPARE, {}
    while counts:
        limits = labelled.sparkSession.createDataFrame([(k, min(1 << 62, (spare * docs_per_language << 62) // n)) for k, n in counts.items()], "__lang string, __limit long")
        some = rows.join(F.broadcast(limits), F.col("lang") == F.col("__lang")).withColumn("__h", place).where(F.col("__h") <= F.col("__limit"))
        some = some.withColumn("__t", F.regexp_like("text", F.lit(r"\p{L}"))).where("__t")
        first = Window.partitionBy("lang").orderBy(F.greatest(F.length("text"), F.lit(LONGEST)), "__h", "doc_id", "text")
        chosen = some.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= docs_per_language)
        for r in chosen.select("lang", "__n", "text").collect():  # bounded by docs_per_language
            got.setdefault(r.lang, {})[r["__n"]] = plain(r.text)
        counts = {k: n for k, n in counts.items() if len(got.get(k, ())) < docs_per_language and n > spare * docs_per_language}
        spare *= 16
    return {k: [t for _, t in sorted(v.items()) if t] for k, v in got.items() if any(v.values())}


def predictions(docs: DataFrame, texts: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """The given columns, and lang_pred, score, bits. Rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(texts))
    of = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))
    schema = StructType([*of.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])

    def task(batches):
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                names, scores, bits = m.predict(b.column(b.num_columns - 1).to_pylist())
                yield pa.record_batch([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=schema.names)

    return of.mapInArrow(task, schema)


#: A text is judged against windows of the longest of these lengths that it reaches, and not at all below the first.
LENGTHS, FOLDS, LEAST_WINDOWS = (64, 128, 256, 512, 1024), 5, 10


def fits(texts: dict[str, list[str]]) -> dict[str, list[tuple[int, float]]]:
    """language -> (length, pieces a character), rising: a text of that length that needs more is in no known language.

    Each fifth of a language's text is parsed by the other four, in windows of that length, and
    so are the same windows with their letters shuffled: both have the length of the text that
    is judged, and both were parsed by as much text, so that neither length nor amount of
    training shifts the limit. It lies midway between the worst window and the median shuffled
    one; where these aren't apart, or windows are few, that length has no limit.
    """
    out: dict[str, list[tuple[int, float]]] = {}
    for k, v in texts.items():
        joined = "\n".join(v)
        own, mixed = {n: [] for n in LENGTHS}, {n: [] for n in LENGTHS}
        size, rnd = -(-len(joined) // FOLDS), random.Random(0)
        for at in range(0, len(joined), max(1, size)):
            held = joined[at : at + size].replace("\n", " ")
            rest = Model({k: [joined[:at], joined[at + size :]]})
            windows = [held[start : start + n] for n in LENGTHS for start in range(0, len(held) - n + 1, n)]
            shuffled = ["".join(rnd.sample(w, len(w))) for w in windows]
            for to, some in ((own, windows), (mixed, shuffled)):
                for w, n in zip(some, rest.pieces(some)[:, 0].tolist(), strict=True):
                    to[len(w)].append(n / len(w))
        worst = [(n, max(own[n]), statistics.median(mixed[n])) for n in LENGTHS if len(own[n]) >= LEAST_WINDOWS]
        out[k] = [(n, (a + b) / 2) for n, a, b in worst if a < b]
    return out


def fitting(m: Model, limits: dict[str, list[tuple[int, float]]], texts: list[str | None]) -> list[bool]:
    """Whether each text is in a known language: not "und", and no worse parsed than a text of its length."""
    names, _, bits = m.predict(texts)
    out = []
    for text, name, x in zip(texts, names, bits, strict=True):
        of = limits.get(name, [])
        rate = x / m.bits[m.languages.index(name)] if of else 0.0
        if of and rate > min(limit for _, limit in of):
            size = len(plain(text))
            of = [limit for n, limit in of if n <= size]
            out.append(not of or rate <= of[-1])
        else:
            out.append(name != "und")
    return out


def known_language(docs: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """docs, in its own columns, without texts that are in no known language ("und", or no fit)."""
    shared, at, schema = docs.sparkSession.sparkContext.broadcast((Model(texts), fits(texts))), docs.columns.index("text"), docs.schema

    def task(batches):
        m, limits = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                yield b.filter(pa.array(fitting(m, limits, b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(task, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    texts = training(docs.where(~held_out(F.col("doc_id"))))
    return predictions(docs, texts, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
