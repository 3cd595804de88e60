"""Personal data by a character-level bidirectional LSTM with a CRF (method 4).

Base: patterns for e-mail, IP, card and phone, which always stay. The model adds spans
that patterns miss (numbers run together, written in other ways, masked addresses). It is
trained in numpy from labelled spans: examples() writes them from a seed, and train()
takes any others. Tags are O and begin/inside of each kind.

Decoding: windows of `WINDOW` characters every `STRIDE` are run where one of them holds a
trigger (a digit, @, or a bracketed at/dot: no kind is without one). The windows'
emissions are averaged, weighted towards each window's middle, and one Viterbi path is
found over each unbroken stretch of windows, so that a span is decided once. Added spans
that overlap a base span are dropped.

The model (about 20 KB) is trained on the driver, kept in the shared folder and broadcast. Texts
without a trigger are passed over by a linear-time scan of the whole text. No shuffle.

Edge cases: null is an empty text; both have no spans. Repeated rows each get their row.
Positions count code points; the end is exclusive. Very long texts are decoded in parts
of `PART` windows, which is where memory is bounded; parts overlap by a window.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import storage
from . import common
from .secret_scan import joined

# The base patterns, in forms that read each character a bounded number of times. An e-mail's local part is
# read backwards from its @; an IP's numbers and a card's digits are taken whole, as giving some back can't help.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

TRIGGER = r"[0-9@]|[(\[{<] ?(?:at|AT|dot|DOT) ?[)\]}>]"
TRIGGERS = re.compile(TRIGGER)
WINDOW, STRIDE, PART = 128, 64, 2048
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k: begin of kind k; 2 + 2k: inside
HIDDEN, EMBED, SYMBOLS = 16, 12, 100
EXAMPLES, EPOCHS, BATCH, RATE, SEED, LEAST = 2400, 9, 48, 0.012, 3, 7


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of each e-mail address: for each @ the characters before it as far as they may be, after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end)."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits(m)) <= 19 and luhn(d)]
    return out + ([(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15] if "+" in text else [])


def symbols(text: str) -> np.ndarray:
    """Characters as numbers below SYMBOLS: ASCII 32..126 each; white space, letters and others else."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((x >= 32) & (x < 127), x - 32, np.where(x < 32, 95, np.where((x >= 0xC0) & (x < 0x3000), 96, 97)))


# ---- labelled examples


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of WINDOW characters and their labelled spans (start, kind, end)."""
    rnd = random.Random(seed)
    pieces = ["the", "an", "er", "in", "tion", "sch", "eau", "ción", "que", "lich", "ou", "st", "ä", "é", "ing", "re", "ll", "o", "be", "und"]
    word = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.choice((1, 1, 2, 2, 3)))) + rnd.choice(("", "", "", "", ",", ".", "###", "!!"))
    digits = lambda a, b=None: "".join(rnd.choice("0123456789") for _ in range(rnd.randint(a, b or a)))
    low = lambda a, b: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(a, b)))
    mixed = lambda a, chars: "".join(rnd.choice(chars) for _ in range(a))

    def email() -> str:
        at, dot = rnd.choice((("@", "."),) * 6 + ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", " . ")))
        who = low(3, 8) + rnd.choice(("", "." + digits(2), "." + low(2, 7), "_" + low(2, 5), digits(1, 3)))
        return who + at + rnd.choice((low(3, 9), "mail" + digits(1))) + rnd.choice(("", dot + "example")) + dot + rnd.choice(("com", "org", "net", "de", "fr"))

    def ip() -> str:
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4)) if rnd.random() < 0.9 else ":".join(mixed(4, "0123456789abcdef") for _ in range(8))

    def card() -> str:
        d = rnd.choice(("4", "5", "37", "6")) + digits(14)
        gap = rnd.choice(("", "", "", " ", "-"))
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rnd.choice((f"+{digits(1)} ({a}) {b}-{c}",) * 4 + (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {c} {digits(4)}", f"+{digits(2)}{a}{b}{c}"))

    def other() -> str:
        return rnd.choice((digits(1, 4), f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", f"{digits(1, 3)}.{digits(1, 2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1, 3)},{digits(3)}", f"{digits(1, 2)}:{digits(2)}", "password=" + mixed(18, "0123456789abcdef"), 'token = "' + mixed(40, "0123456789abcdef") + '"', "AKIA" + mixed(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "@" + low(3, 8), f"Version {digits(1)}.0", digits(5, 9), f"{digits(1, 2)}%", "$" + digits(2, 5), digits(24, 30), low(2, 6) + digits(1, 4)))

    make, out = (email, ip, card, phone), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            p = rnd.random()
            if p < 0.16:
                for _ in range(rnd.choice((1, 1, 2, 3))):
                    k = rnd.randrange(4)
                    s = make[k]()
                    spans.append((len(text), k, len(text) + len(s)))
                    text += s + rnd.choice((" ", " ", " ", ". ", ", ", "\n"))
            elif p < 0.26:
                text += other() + rnd.choice((" ", " ", ". ", "\n"))
            else:
                text += (word().upper() if rnd.random() < 0.05 else word().capitalize() if rnd.random() < 0.1 else word()) + (" " if rnd.random() < 0.95 else "\n")
        cut = rnd.randrange(max(1, len(text) - WINDOW + 1))
        inside = [(max(0, s - cut), k, min(WINDOW, e - cut)) for s, k, e in spans if e > cut and s < cut + WINDOW]
        out.append((text[cut : cut + WINDOW], inside))
    return out


def tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for s, k, e in spans:
        y[s:e], y[s] = 2 + 2 * k, 1 + 2 * k
    return y


# ---- the model


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Model:
    """Parameters by name; all arithmetic is numpy."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.5, (SYMBOLS, EMBED)), "V": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "v": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, 0.3, (EMBED, 4 * HIDDEN)), f"U{d}": r.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (direction, batch, time, HIDDEN), both directions in their own reading order, moved together."""
        p, both = self.p, np.arange(2)[:, None]
        z_of, u = np.stack([p["E"] @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"]), np.stack([p["Uf"], p["Ub"]])
        xs = np.stack([x, x[:, ::-1]])
        n, steps = x.shape
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((steps, 2, n, HIDDEN), np.float32)
        for t in range(steps):
            z = z_of[both, xs[:, :, t]]
            z += h @ u
            s = sigmoid(z[:, :, : 3 * HIDDEN])
            i, f, o, g = s[:, :, :HIDDEN], s[:, :, HIDDEN : 2 * HIDDEN], s[:, :, 2 * HIDDEN :], np.tanh(z[:, :, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            q = np.tanh(c)
            if trace is not None:
                trace.append((h, before, i, f, o, g, q))
            h = out[t] = o * q
        return out.transpose(1, 2, 0, 3)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = self.states(x)
        return np.concatenate([h[0], h[1][:, ::-1]], 2) @ self.p["V"] + self.p["v"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (n, steps) = self.p, x.shape
        trace: list = []
        hs = self.states(x, trace)
        h = np.concatenate([hs[0], hs[1][:, ::-1]], 2)
        e, a = h @ p["V"] + p["v"], p["A"]
        # CRF: forward and backward in scaled probabilities
        ex, ea = np.exp(e - e.max(2, keepdims=True)), np.exp(a)
        alpha, beta, norm = np.empty_like(ex), np.ones_like(ex), np.empty((n, steps), np.float32)
        for t in range(steps):
            v = ex[:, t] * (alpha[:, t - 1] @ ea if t else 1)
            norm[:, t] = v.sum(1)
            alpha[:, t] = v / norm[:, t, None]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = (beta[:, t + 1] * ex[:, t + 1]) @ ea.T / norm[:, t + 1, None]
        rows, times = np.arange(n)[:, None], np.arange(steps)[None, :]
        de = alpha * beta
        de[rows, times, y] -= 1
        right = beta[:, 1:] * ex[:, 1:] / norm[:, 1:, None]
        da = ea * np.einsum("nti,ntj->ij", alpha[:, :-1], right)
        da -= np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gold = e[rows, times, y].sum() + a[y[:, :-1], y[:, 1:]].sum()
        loss = float((np.log(norm).sum() + e.max(2).sum() - gold) / n)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de /= n
        g["A"], g["v"], g["V"] = da / n, de.sum((0, 1)), np.einsum("nth,ntk->hk", h, de)
        dh = de @ p["V"].T
        parts = np.stack([dh[:, :, :HIDDEN], dh[:, ::-1, HIDDEN:]])
        u = np.stack([p["Uf"].T, p["Ub"].T])
        back_h = back_c = np.zeros((2, n, HIDDEN), np.float32)
        dz = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
        du = np.zeros((2, HIDDEN, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            before_h, before_c, i, f, o, gg, q = trace[t]
            grad = parts[:, :, t] + back_h
            c = back_c + grad * o * (1 - q * q)
            z = np.concatenate([c * gg * i * (1 - i), c * before_c * f * (1 - f), grad * q * o * (1 - o), c * i * (1 - gg * gg)], 2)
            du += before_h.transpose(0, 2, 1) @ z
            dz[t], back_h, back_c = z, z @ u, c * f
        for k, d in enumerate("fb"):
            flat, seen = dz[:, k].transpose(1, 0, 2).reshape(-1, 4 * HIDDEN), (x if d == "f" else x[:, ::-1]).ravel()
            g[f"U{d}"], g[f"b{d}"] = du[k], flat.sum(0)
            order = np.argsort(seen, kind="stable")
            first = np.flatnonzero(np.diff(seen[order], prepend=-1))
            by = np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
            by[seen[order][first]] = np.add.reduceat(flat[order], first)
            g[f"W{d}"] = p["E"].T @ by
            g["E"] += by @ p[f"W{d}"].T
        return loss, g


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = SEED, batch: int = BATCH, rate: float = RATE) -> Model:
    """A model from texts of one length and their spans (start, kind, end)."""
    m, r = Model(seed), np.random.default_rng(seed)
    x = np.stack([symbols(t) for t, _ in labelled])
    y = np.stack([tags(len(t), s) for t, s in labelled])
    mean, square, step = {k: 0.0 for k in m.p}, {k: 0.0 for k in m.p}, 0
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            _, g = m.gradients(x[order[at : at + batch]], y[order[at : at + batch]])
            scale = min(1.0, 5.0 / (1e-6 + float(np.sqrt(sum((v * v).sum() for v in g.values())))))
            step += 1
            now = rate * (1 - 0.95 * step / total)
            for k in m.p:
                d = g[k] * scale
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * d, 0.999 * square[k] + 0.001 * d * d
                m.p[k] = (m.p[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


@functools.cache
def default_model() -> Model:
    return train(examples())


def stored_model(spark) -> Model:
    """default_model(), trained once for all sessions that share spark.checkpoint.dir: parameters lie there by a digest of what they follow from."""
    about = repr((EXAMPLES, EPOCHS, BATCH, RATE, SEED, HIDDEN, EMBED, SYMBOLS, TAGS, WINDOW, examples(3)))
    path = f"{storage.root_of(spark)}/readloom-models/pii-{hashlib.sha256(about.encode()).hexdigest()[:24]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = [(k, list(v.shape), bytearray(v.tobytes())) for k, v in default_model().p.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    m = Model()
    m.p = {r.name: np.frombuffer(bytes(r.data), np.float32).reshape(r.shape) for r in spark.read.parquet(path).collect()}  # the parameters, 20 KB
    return m


# ---- decoding


def viterbi(e: list[np.ndarray], a: np.ndarray) -> list[np.ndarray]:
    """The best tags of each sequence of emissions; all sequences move together."""
    order = sorted(range(len(e)), key=lambda i: -len(e[i]))
    longest = len(e[order[0]])
    live = [sum(len(x) > t for x in e) for t in range(longest)]
    score = np.stack([e[i][0] for i in order])
    back: list[np.ndarray] = []
    for t in range(1, longest):
        k = live[t]
        v = score[:k, :, None] + a
        best = v.argmax(1)
        back.append(best)
        score[:k] = np.take_along_axis(v, best[:, None], 1)[:, 0] + np.stack([e[i][t] for i in order[:k]])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(e)
    for row, i in enumerate(order):
        y = np.empty(len(e[i]), np.int64)
        y[-1] = score[row].argmax()
        for t in range(len(y) - 1, 0, -1):
            y[t - 1] = back[t - 1][row, y[t]]
        out[i] = y
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """(first, last) numbers of windows in unbroken stretches; window w starts at w * STRIDE."""
    out: list[list[int]] = []
    for m in TRIGGERS.finditer(text):
        last = m.start() // STRIDE
        first = max(0, last - WINDOW // STRIDE + 1)
        if out and first <= out[-1][1] + 1 and last - out[-1][0] < PART:
            out[-1][1] = max(out[-1][1], last)
        elif not out or last > out[-1][1]:
            out.append([first if not out else max(first, out[-1][1]), last])
    return [(a, b) for a, b in out]


WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def model_spans(texts: list[str], m: Model) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the model finds in each text."""
    found: list[set] = [set() for _ in texts]
    cut: list[set] = [set() for _ in texts]
    todo = []
    for i, t in enumerate(texts):
        of = stretches(t)
        # whether the parts before and after share windows with this one
        todo += [(i, a, b, k > 0 and of[k - 1][1] >= a, k + 1 < len(of) and of[k + 1][0] <= b) for k, (a, b) in enumerate(of)]
    for at in range(0, len(todo), 256):
        group = todo[at : at + 256]
        rows, lengths = [], []
        for i, a, b, *_ in group:
            x = symbols(texts[i][a * STRIDE : b * STRIDE + WINDOW])
            lengths.append(len(x))
            x = np.concatenate([x, np.full((b - a) * STRIDE + WINDOW - len(x), 95)])
            rows.append(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STRIDE])
        every = np.concatenate(rows)
        scores = np.concatenate([m.emissions(every[k : k + 2048]) for k in range(0, len(every), 2048)])
        em, k = [], 0
        for (_, a, b, *_), n in zip(group, lengths, strict=True):
            total = np.zeros(((b - a) * STRIDE + WINDOW, TAGS), np.float32)
            weight = np.zeros((len(total), 1), np.float32)
            for w in range(b - a + 1):
                total[w * STRIDE : w * STRIDE + WINDOW] += scores[k + w] * WEIGHT
                weight[w * STRIDE : w * STRIDE + WINDOW] += WEIGHT
            em.append((total / weight)[:n])
            k += b - a + 1
        for (i, a, _, shared, shares), y in zip(group, viterbi(em, m.p["A"]), strict=True):
            before = np.concatenate(([0], y[:-1]))
            for s in np.flatnonzero((y % 2 == 1) | ((y > 0) & (before != y) & (before != y - 1))).tolist():
                kind, e = (int(y[s]) - 1) // 2, s + 1
                while e < len(y) and y[e] == 2 + 2 * kind:
                    e += 1
                lo, hi = a * STRIDE + s, a * STRIDE + e
                into = cut if (shared and s == 0) or (shares and e == len(y)) else found
                part = texts[i][lo:hi]
                lo += len(part) - len(part.lstrip(" \n\t.,;:"))
                hi -= len(part) - len(part.rstrip(" \n\t.,;:"))
                if hi - lo >= LEAST and TRIGGERS.search(texts[i], lo, hi):
                    into[i].add((lo, kind, hi))
    return [sorted(f | rejoined(c, f)) for f, c in zip(found, cut, strict=True)]


def rejoined(cut: set[tuple[int, int, int]], found: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Of the spans at the edge of a part: those that no span inside a part overlaps; overlapping ones of a kind as one."""
    out: list[tuple[int, int, int]] = []
    for lo, kind, hi in sorted(cut, key=lambda x: (x[1], x[0], x[2])):
        if any(lo < y and x < hi for x, _, y in found):
            continue
        if out and out[-1][1] == kind and lo < out[-1][2]:
            out[-1] = (out[-1][0], kind, max(hi, out[-1][2]))
        else:
            out.append((lo, kind, hi))
    return set(out)


SPANS = "spans array<struct<start:long,kind:int,end:long,base:boolean>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """The given columns and all spans, in order of start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model.p)
    of = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))
    schema = StructType(of.schema.fields[:-1] + StructType.fromDDL(SPANS).fields)

    def task(batches):
        m = Model()
        m.p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                column = b.column(b.num_columns - 1)
                some = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, TRIGGER), False)).to_pylist()
                texts = [column[i].as_py() for i in some]
                spans: list[list[dict]] = [[]] * b.num_rows
                for i, text, added in zip(some, texts, model_spans(texts, m), strict=True):
                    base = base_spans(text)
                    free, end = [], -1
                    for s, k, e in added:
                        if s >= end and not any(s < y and x < e for x, _, y in base):
                            free.append((s, k, e, False))
                            end = e
                    spans[i] = [dict(zip(("start", "kind", "end", "base"), x, strict=True)) for x in sorted([(*x, True) for x in base] + free)]
                yield pa.record_batch([*b.columns[:-1], pa.array(spans, SPAN)], names=schema.names)

    return of.mapInArrow(task, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    found = personal_data(common.table(spark, sf_dir, "documents"), ["doc_id"], stored_model(spark))
    n = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
