"""Identifiers as typed columns: tokens, an inferred layout by chunk, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INT32_MAX, SAMPLE

#: A run of these separates tokens.
SEPARATORS = r"[:/\-.\s]+"
RUN = re.compile(r"[:/\-. \t\r\f\v]+")
INT = re.compile(r"0|[1-9][0-9]*")


def tokens(identifier: Column) -> Column:
    return F.filter(F.split(identifier, SEPARATORS), lambda t: t != "")


def separators(identifier: Column) -> Column:
    """A run before the first or after the last token counts, so such identifiers have as many runs as tokens or more."""
    return F.regexp_extract_all(identifier, F.lit(f"({SEPARATORS})"), F.lit(1))


def canonical(token: Column) -> Column:
    """Digits that read back as they are, and fit 32 bits."""
    return token.rlike("^(0|[1-9][0-9]*)$") & (F.length(token) <= 10) & (token.try_cast("bigint") <= INT32_MAX)


def tokenized(reads: DataFrame) -> DataFrame:
    """reads and tok, sep."""
    return reads.withColumns({"tok": tokens(F.col("identifier")), "sep": separators(F.col("identifier"))})


def layout(reads: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row a chunk: columnar, sep, kinds, from the chunk's first `sample` records.

    The window's limit holds in each task before the exchange.
    """
    first = Window.partitionBy("chunk_id").orderBy("rec")
    some = tokenized(reads.select("chunk_id", "rec", "identifier")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    some = some.withColumn("ints", F.transform("tok", lambda t: canonical(t).cast("int")))
    one = some.groupBy("chunk_id").agg(
        F.count_distinct("sep").alias("seps"),
        F.min(F.size("tok")).alias("least"),
        F.max(F.size("tok")).alias("most"),
        F.bool_and(F.size("sep") + 1 == F.size("tok")).alias("even"),
        F.min("sep").alias("sep"),
        F.collect_list("ints").alias("ints"),  # `sample` rows at most
    )
    same = (F.col("seps") == 1) & (F.col("least") == F.col("most")) & F.col("even")
    kind = F.transform(F.sequence(F.lit(0), F.col("least") - 1), lambda c: F.when(F.forall("ints", lambda r: F.get(r, c) == 1), "int32").otherwise("string"))
    return one.select("chunk_id", same.alias("columnar"), F.when(same, F.col("sep")).alias("sep"), F.when(same, kind).alias("kinds"))


def conforming(reads: DataFrame, layouts: DataFrame) -> DataFrame:
    """reads with tok, kinds and fits: whether the record has its chunk's layout."""
    rows = tokenized(reads).join(layouts.select("chunk_id", "columnar", F.col("sep").alias("want"), "kinds"), "chunk_id")
    typed = F.forall(F.zip_with("tok", "kinds", lambda t, k: (k == "string") | canonical(t)), lambda ok: ok)
    return rows.withColumn("fits", F.col("columnar") & F.coalesce((F.col("sep") == F.col("want")) & (F.size("tok") == F.size("kinds")) & typed, F.lit(False)))


def modes(reads: DataFrame, layouts: DataFrame) -> DataFrame:
    """A row a chunk: its mode; columnar if all its records fit, else flat."""
    fit = conforming(reads, layouts).groupBy("chunk_id").agg(F.bool_and("fits").alias("all"), F.count("*").alias("records"))
    out = fit.join(layouts, "chunk_id")
    columnar = F.col("all") & F.col("columnar")
    return out.select("chunk_id", "records", F.when(columnar, "columnar").otherwise("flat").alias("mode"), F.when(columnar, F.col("sep")).alias("sep"), F.when(columnar, F.col("kinds")).alias("kinds"))


def columns(reads: DataFrame, mode: DataFrame) -> DataFrame:
    """Long form of columnar chunks: chunk_id, rec, col, kind, text, value (of int32 columns)."""
    rows = tokenized(reads.select("chunk_id", "rec", "identifier")).join(mode.where("mode = 'columnar'").select("chunk_id", "kinds"), "chunk_id")
    each = rows.select("chunk_id", "rec", "kinds", F.posexplode("tok").alias("col", "text"))
    kind = F.get("kinds", F.col("col"))
    return each.select("chunk_id", "rec", "col", kind.alias("kind"), "text", F.when(kind == "int32", F.col("text").cast("int")).alias("value"))


def rebuilt(cols: DataFrame, mode: DataFrame) -> DataFrame:
    """chunk_id, rec, identifier from columns() and their separators."""
    rows = cols.groupBy("chunk_id", "rec").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("t")).join(mode.select("chunk_id", "sep"), "chunk_id")
    parts = F.zip_with(F.col("t.text"), F.concat("sep", F.array(F.lit(""))), lambda t, s: F.concat(t, s))
    return rows.select("chunk_id", "rec", F.array_join(parts, "").alias("identifier"))


def flat(reads: DataFrame) -> DataFrame:
    """chunk_id and stream: a chunk's identifiers, one after another."""
    return reads.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec", "identifier"))), lambda r: r["identifier"]), "").alias("stream"))


# ---- the same for one chunk's identifiers in Python, for the chunk encoder


def split_text(identifier: str) -> tuple[list[str], list[str]]:
    return [t for t in RUN.split(identifier) if t], RUN.findall(identifier)


def int_text(t: str) -> bool:
    return bool(INT.fullmatch(t)) and len(t) <= 10 and int(t) <= INT32_MAX


def chunk_layout(identifiers: list[str], sample: int = SAMPLE) -> tuple[list[str], list[str], list[list[str]]] | None:
    """(separators, kinds, columns of tokens) if the chunk is columnar, else None."""
    if not identifiers:
        return None
    first = [split_text(x) for x in identifiers[:sample]]
    tok, sep = first[0]
    if any(s != sep or len(t) != len(tok) for t, s in first) or len(sep) + 1 != len(tok):
        return None
    kinds = ["int32" if all(int_text(t[c]) for t, _ in first) else "string" for c in range(len(tok))]
    rows = []
    for x in identifiers:
        t, s = split_text(x)
        if s != sep or len(t) != len(tok):
            return None
        rows.append(t)
    cols = [list(c) for c in zip(*rows, strict=True)]
    if any(k == "int32" and not all(map(int_text, set(c))) for k, c in zip(kinds, cols, strict=True)):  # a value once, however often it occurs
        return None
    return sep, kinds, cols
