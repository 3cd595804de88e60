"""Secret scanning by token efficiency (method 2).

Base: patterns for assigned secrets, access keys and long hexadecimal strings. The
method adds random strings: a candidate is a maximal run of A-Z a-z 0-9 + / _ = - of
`MIN_LENGTH` characters or more; it is encoded with a public byte-level BPE vocabulary,
and natural words take many characters a token while random ones take few. A candidate
counts if it has at most `MAX_RATIO` characters a token, with digits or without, unless
it is a known digest (exactly 32, 40, 56, 64, 96 or 128 hexadecimal digits of one case
that a digest's name or "sha"/"md5"/"commit" precedes), an identifier (UUID, a number
with separators, a date; words joined by separators or with a number after them, where
each run of `WORD_LENGTH` letters or more takes over `MAX_RATIO` characters a token) or
lies in a base span.

Linear-time scans by a compiled engine (RE2, through Arrow) find the few texts that hold
any candidate; only those reach Python's patterns. No shuffle.

Edge cases: null is an empty text; both give no spans. Repeated rows each get their row.
Positions count code points; the end is exclusive.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MANY_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH, MAX_RATIO = 16, 2.2
WORD_LENGTH = 8  # shorter letters tell nothing of themselves
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
DIGEST_NAME = re.compile(r"(?:md5|sha-?\d*|digest|checksum|commit|etag|integrity|hash)[\s:=(\"'-]*$", re.IGNORECASE)
IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9/_=+-]+")
OF_WORDS = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[/_=+-]+(?:[A-Za-z]+|[0-9]+))+|[A-Za-z]+[0-9]{1,8}")
LETTERS = re.compile(r"[A-Za-z]{%d,}" % WORD_LENGTH)

#: RE2: a text without a match has no base span and no candidate.
SOME = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{%d}" % MIN_LENGTH


class Efficiency:
    """Characters a token under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self.of = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, float] = {}

    def __call__(self, s: str) -> float:
        if s not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[s] = len(s) / len(self.of.encode_ordinary(s))
        return self.seen[s]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in MANY_HEX.finditer(text)]


def random_spans(text: str, ratio, base: list[tuple[int, int, int]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s, a, e = m[0].strip("=-_/+"), m.start(), m.end()
        if len(s) < MIN_LENGTH:
            continue
        if any(x < e and a < y for x, _, y in base) or IDENTIFIER.fullmatch(s):
            continue
        if OF_WORDS.fullmatch(s) and all(ratio(w) > max_ratio for w in LETTERS.findall(s)):
            continue
        if len(s) in DIGEST_SIZES and DIGEST.fullmatch(s) and DIGEST_NAME.search(text[max(0, a - 24) : a]):
            continue
        if ratio(s) <= max_ratio:
            start = a + m[0].index(s)
            out.append((start, 3, start + len(s)))
    return out


SPANS = "spans array<struct<start:long,kind:int,end:long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def secrets(docs: DataFrame, columns: list[str], vocabulary: str, pattern: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The given columns and all spans, in order of start and kind."""
    of = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))
    schema = StructType(of.schema.fields[:-1] + StructType.fromDDL(SPANS).fields)

    def task(batches):
        ratio = None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(b.num_columns - 1)
                spans: list[list[dict]] = [[]] * b.num_rows
                some = pc.match_substring_regex(texts, SOME)
                for i in pc.indices_nonzero(pc.fill_null(some, False)).to_pylist():
                    text = texts[i].as_py()
                    if ratio is None:
                        ratio = Efficiency(vocabulary, pattern)
                    found = base_spans(text)
                    found = sorted(found + random_spans(text, ratio, found, max_ratio))
                    spans[i] = [{"start": s, "kind": k, "end": e} for s, k, e in found]
                yield pa.record_batch([*b.columns[:-1], pa.array(spans, SPAN)], names=schema.names)

    return of.mapInArrow(task, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """text with each span, or run of overlapping spans, replaced."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(spans: F.Column, names: tuple[str, ...]) -> F.Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets(common.table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
