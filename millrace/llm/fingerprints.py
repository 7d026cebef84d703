"""Canonical exact document fingerprints, with DataFrame and SQL functions only.

A text is brought to Unicode NFC, case-folded, its runs of white space become one space and
its ends are trimmed. The fingerprint is 128 bits wide: two XXH64 of the canonical UTF-8 with
different seeds. Documents are grouped by it; inside each bucket that holds more than one
document, the canonical bytes themselves are compared, and a bucket that held different bytes
is parted by them.

Defined results: a null text is empty; repeated rows are fingerprinted each; a null doc_id has
no next document and no group (its replacement is empty, its likeness to a next one 0); if a doc_id is
repeated, its least text counts as the next document's; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, reducers, salted_join, stored

#: The JVM's own Unicode functions, called by name.
COMPOSE = "reflect('com.ibm.icu.text.Normalizer', 'compose', {0}, false)"
FOLD = "reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {0}, true)"
SPACES = r"[\s\p{Z}\x{85}]+"


def canonical(column: str) -> Column:
    folded = F.expr(COMPOSE.format(FOLD.format(COMPOSE.format(column))))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def _hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def digest(canon: str) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.concat(_hex(F.xxhash64(F.col(canon))), _hex(F.xxhash64(F.lit(0x9E3779B9), F.col(canon))))


def fingerprinted(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds `canon` and `fingerprint` of a text column that has no nulls."""
    return docs.withColumn("canon", canonical(column)).withColumn("fingerprint", digest("canon"))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids: the next lower one, and the highest for the lowest.

    The ids are dealt by range and frozen; only one row for each range meets in one place.
    """
    n = reducers(ids.sparkSession)
    dealt = stored(ids.select("doc_id").repartitionByRange(n, F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    over = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    return dealt.withColumn("lower", F.lead("doc_id").over(inside)).join(F.broadcast(heads), "part").select("doc_id", F.coalesce("lower", "after").alias("next_id"))


def groups(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id): the least doc_id with the same canonical bytes, for documents in buckets of several.

    texts: (doc_id, text) without nulls; known: (doc_id, fingerprint) of all rows. Texts are read again only for such buckets; a
    bucket is proven equal if its least and its greatest canonical text are the same bytes.
    """
    many = known.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    members = salted_join(known, many, ["fingerprint"], "doc_id").groupBy("doc_id", "fingerprint").agg(F.count("*").alias("rows"))
    doubtful = texts.join(members, "doc_id").select("doc_id", "text", F.col("fingerprint").alias("own"))
    copies = fingerprinted(doubtful).where("fingerprint = own").select("doc_id", "fingerprint", "canon")
    buckets = copies.groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most"), F.min("doc_id").alias("group_id"))
    buckets = stored(buckets.select("fingerprint", "group_id", (F.col("least") == F.col("most")).alias("same")), "buckets")
    proven = salted_join(members, buckets.where("same"), ["fingerprint"], "doc_id").select("doc_id", "fingerprint", "group_id")
    parted = copies.join(buckets.where("not same").select("fingerprint"), "fingerprint")
    ids = parted.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"))
    return proven.unionByName(parted.join(ids, ["fingerprint", "canon"]).select("doc_id", "fingerprint", "group_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and their likeness."""
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = fingerprinted(texts).select("doc_id", "fingerprint", F.char_length("text").cast("long").alias("n_chars"))
    known = stored(known, "fingerprints")
    # the joins below all read this same table of named documents, so that its texts are dealt once
    named = texts.where("doc_id is not null")
    ids = known.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("most"), F.min("fingerprint").alias("least_print"))
    asked = successors(ids).join(ids.select("doc_id", F.floor(F.col("most") / 3).cast("int").alias("k")), "doc_id").select(F.col("doc_id").alias("asker"), F.col("next_id"), "k")
    heads = named.join(asked, F.col("doc_id") == F.col("next_id")).select("asker", F.substring("text", F.lit(1), F.col("k")).alias("head"))
    heads = heads.groupBy(F.col("asker").alias("doc_id")).agg(F.min("head").alias("head"))
    next_print = asked.join(ids.select(F.col("doc_id").alias("next_id"), F.col("least_print").alias("next_fingerprint")), "next_id").select(F.col("asker").alias("doc_id"), "next_fingerprint")
    grouped = groups(named, known.select("doc_id", "fingerprint"))
    grouped = grouped.groupBy(F.col("doc_id").alias("member"), F.col("fingerprint").alias("own")).agg(F.min("group_id").alias("group_id"))
    out = named.join(heads, "doc_id", "left").join(next_print, "doc_id", "left")
    out = out.unionByName(texts.where("doc_id is null"), allowMissingColumns=True)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    out = out.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut)))
    out = fingerprinted(out).withColumn("edited_canon", canonical("edited")).withColumn("edited_fingerprint", digest("edited_canon"))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    out = out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"),
    )
    # only digests take part in this join, no texts
    out = out.join(grouped, (F.col("doc_id") == F.col("member")) & (F.col("fingerprint") == F.col("own")), "left")
    return out.withColumn("group_id", F.coalesce("group_id", "doc_id")).drop("member", "own")
