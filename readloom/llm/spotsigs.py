"""Document fingerprints: SpotSigs (method 7, native).

Common words are anchors. A signature is a run of anchors, then the chain of the next
`2` content words (anchors between them are passed over). A text's fingerprint is its
set of signatures, as 32-bit hashes in order; likeness is their Jaccard similarity.

Native: lower-casing, one regular expression that cuts the text into pieces "anchors
content-word", and array functions. No Python runs on executors, and each array
function is linear in the text.

similar_pairs() joins fingerprints: partitions by set length, such that a pair at the
threshold is in one partition or in two adjacent ones, and there candidates share one of
the rarest signatures of each set (prefixes as long as the threshold needs), with equal
sets merged first. Pairs are then compared exactly.

Edge cases: null is an empty text. A text without any signature has a single one, made
of all its words, so equal texts have equal fingerprints and others do not; without any
word the text as it is. Two empty texts are alike (1). Repeated doc_ids are in order of
text. A single row's next document is itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Common words of English, French, German and Spanish.
ANCHORS = """a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you
au aux avec ce ces dans de des du elle en est et il la le les ne nous ou par pas pour que qui sa se ses son sont sur un une vous
als auch auf aus bei das dem den der die ein eine einem einen einer er es für ich im ist mit nach nicht sich sie sind und von war wie wir zu zum zur
al como con del el ella ellos era este esta ha los las lo más no o para pero por su sus también una y""".split()


def trie(words: list[str]) -> str:
    """One regular expression for all words, longest first, that looks at each letter once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [c + trie(rest) for c, rest in heads.items()]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return (f"(?:{body})?" if "" in words else body) if parts else ""


#: From a word's start: the anchors there, and the content word after them.
PIECE = " ?+((?:" + trie(ANCHORS) + " )*+[^ ]++)"
THRESHOLD = 0.6


def plain(text: F.Column) -> F.Column:
    """Lower-case words with a space after each."""
    return F.regexp_replace(F.concat(F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]++", " ")


def fingerprinted(df: DataFrame, text: str, to: str) -> DataFrame:
    """df and `to`, the sorted distinct hashes of the signatures of a text column.

    Words and pieces are columns of their own: an expression used twice in an array
    function would be computed twice.
    """
    end = F.lit("|")  # a last content word, so that anchors at the end stay anchors
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = df.withColumn("__w", plain(whole)).withColumn("__p", F.regexp_extract_all(F.concat("__w", end), F.lit(PIECE), F.lit(1)))
    n = F.greatest(F.size("__p") - 2, F.lit(0))
    chained = F.zip_with(F.slice("__p", 1, n), F.slice("__p", 2, n), lambda a, b: F.when(F.instr(a, " ") > 0, F.hash(a, F.substring_index(b, " ", -1))))
    sigs = cut.withColumn(to, F.sort_array(F.array_distinct(F.array_compact(chained))))
    words = F.trim("__w")
    return sigs.withColumn(to, F.when(F.size(to) > 0, F.col(to)).otherwise(F.array(F.hash(F.when(words != "", words).otherwise(whole))))).drop("__w", "__p")


def likeness(a: str, b: str) -> F.Column:
    """Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both).cast("double")


def followed(docs: DataFrame, derive, columns: list[str]) -> DataFrame:
    """docs (doc_id, text) after derive(), with next_<column> of the next row in doc_id's order (the last: the first).

    One exchange: ranges of doc_id are buckets, and a window runs in each; the first row of
    each bucket is also put at the end of the bucket before.
    """
    spark = docs.sparkSession
    n = 2 * common.parts(spark)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    bucket = F.lit(0)
    if cuts:
        bucket = F.greatest(F.lit(0), F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))), F.lit(0)))
    rows = docs.withColumn("__b", bucket)
    least = rows.groupBy("__b").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("null"))
    present = [(r["__b"], None if r["null"] else r["doc_id"]) for r in sorted(least.collect(), key=lambda r: r["__b"])]  # a row a bucket
    firsts = common.values(spark, [(present[k - 1][0], i) for k, (_, i) in enumerate(present)], "__to int, __first long")
    heads = docs.join(F.broadcast(firsts), docs.doc_id.eqNullSafe(F.col("__first"))).groupBy("__to").agg(F.min(F.struct("doc_id", "text")).alias("__r"))
    heads = heads.select("__r.*", F.col("__to").alias("__b"))
    raw = rows.withColumn("__end", F.lit(0)).unionByName(heads.withColumn("__end", F.lit(1)))
    every = derive(raw.repartitionByRange(common.parts(spark), "__b"))  # ranges of buckets: tasks of equal size
    w = Window.partitionBy("__b").orderBy("__end", "doc_id", "text")
    led = every.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return led.where("__end = 0").drop("__b", "__end")


def level(c: F.Column, t: float) -> F.Column:
    """The partition of a set length: sets as alike as t are in one partition or in two adjacent ones."""
    return F.floor(F.ln(c) / F.lit(-math.log(t)) + F.lit(1e-9)).cast("int")


def similar_pairs(docs: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) of equal fingerprints, and pairs (a, b, likeness) of class_ids as alike as t.

    class_id is the least doc_id of its class; doc_ids are unique and not null.
    """
    own = fingerprinted(docs.select("doc_id", "text"), "text", "sigs").select("doc_id", "sigs")
    members = own.withColumn("class_id", F.min("doc_id").over(Window.partitionBy("sigs"))).select("doc_id", "class_id")
    sets = common.keep(own.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs")), "sets")
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    rare = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    ranked = rare.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by"))
    prefix = F.slice("by", 1, (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int"))
    index = ranked.select("id", "n", level(F.col("n"), t).alias("level"), F.explode(prefix).alias("p")).select("id", "n", "level", "p.sig")
    left = index.select(*[F.col(c).alias(f"{c}1") for c in index.columns]).withColumn("to", F.explode(F.array("level1", F.col("level1") + 1)))
    met = left.join(index, (F.col("sig1") == F.col("sig")) & (F.col("to") == F.col("level")) & (F.col("n1") >= t * F.col("n")) & (F.col("n") >= t * F.col("n1")) & ((F.col("level1") < F.col("level")) | (F.col("id1") < F.col("id"))))
    pairs = met.select(F.col("id1").alias("a"), F.col("id").alias("b")).distinct()
    s = lambda c, to: sets.select(F.col("id").alias(c), F.col("sigs").alias(to))
    exact = pairs.join(s("a", "x"), "a").join(s("b", "y"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness("x", "y").alias("likeness"))
    return members, exact.where(F.col("likeness") >= t - 1e-12)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = followed(docs, lambda d: fingerprinted(d, "text", "sigs"), ["text", "sigs"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half))
    both = fingerprinted(own.withColumn("edited", edited), "edited", "edited_sigs")
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), show("sigs").alias("fingerprint"), show("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"))
