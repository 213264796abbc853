"""Threshold-scaled document sketches, in SQL functions only.

A sketch is the sorted array of all shingle hashes below a fixed fraction of the
hash range, and of the LEAST least hashes where these are fewer, so that short
texts have one, too. It grows with the document, so a short text can be looked
for in a long one. Up to its bound (see `bound`) a sketch has every hash of its
text; two sketches are compared, or merged, up to the lower of their bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The part of the hash range that is kept, and how many hashes are kept at least.
FRACTION, LEAST = 1 / 8, 64


def _limit(fraction: float) -> int:
    return int(-(2**63) + fraction * 2**64)


def sketch(text: Column, fraction: float = FRACTION, shingle: int = 5, least: int = LEAST) -> Column:
    """The sketch of a text as array<bigint>: its shingles of `shingle` words, or the whole of a shorter text.

    Empty for null, empty and blank texts only.
    """

    def of(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]),  # beyond the end: null, which is skipped
        ))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")
    hashes = let(words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(F.array().cast("array<bigint>")))
    # Most hashes of a long text go first, so that only short ones are put in order whole.
    return let(hashes, lambda h: let(
        F.array_distinct(F.filter(h, lambda x: x < F.lit(_limit(fraction)))),
        lambda low: F.when(F.size(low) >= least, F.sort_array(low)).otherwise(F.slice(F.sort_array(F.array_distinct(h)), F.lit(1), F.lit(least))),
    ))


def bound(a: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The hash up to which a sketch has all hashes of its text."""
    return F.when(F.size(a) < least, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(_limit(fraction) - 1), F.element_at(a, -1)))


def _shared(a: Column, b: Column, then: Callable[[Column, Column], Column], fraction: float, least: int) -> Column:
    """then(a, b) of what two sketches have up to the lower of their bounds."""
    upto = lambda s, most: F.filter(s, lambda h: h <= most)
    return let(F.least(bound(a, fraction, least), bound(b, fraction, least)), lambda most: then(upto(a, most), upto(b, most)))


def merged(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of both texts together."""
    return _shared(a, b, lambda x, y: F.sort_array(F.array_union(x, y)), fraction, least)


def containment(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimates which share of a's shingles b has; null if there is nothing to tell it from, as for an empty a."""
    return _shared(a, b, lambda x, y: F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0)), fraction, least)


def likeness(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimates the Jaccard similarity of the shingle sets; equal sketches, empty ones too, have 1."""

    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda both: F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(1.0)))

    return _shared(a, b, of, fraction, least)


def as_text(a: Column) -> Column:
    """16 lower-case hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Stands for a null doc_id, as the least of all.
NO_ID = -(2**63)


def following(ids: DataFrame) -> DataFrame:
    """Adds `next_k` to `ids` (k: bigint, distinct; other columns are kept): the next k in descending order; after the last, the first.

    Ranges of k are put in order apart from each other. Where one ends, the
    first k of the next range follows; there is one such row for each range.
    """
    placed = stash(ids.repartitionByRange(F.col("k").desc()).withColumn("__range", F.spark_partition_id()), "ids")
    ends = placed.groupBy(F.col("__range").alias("__r")).agg(F.max("k").alias("__first"))
    order = Window.orderBy(F.col("__first").desc())
    top = F.max("__first").over(Window.partitionBy())
    ends = ends.select("__r", F.coalesce(F.lead("__first").over(order), top).alias("__after"))
    within = F.lead("k").over(Window.partitionBy("__range").orderBy(F.col("k").desc()))
    return placed.withColumn("__lead", within).join(ends, F.col("__range") == F.col("__r")).select(
        *ids.columns, F.coalesce("__lead", "__after").alias("next_k")
    )


def fingerprints_with_edits(docs: DataFrame, fraction: float = FRACTION, shingle: int = 5, least: int = LEAST) -> DataFrame:
    """Sketches of all `docs` (doc_id, text; other columns are ignored) and of their edited texts.

    The edited text has its last third replaced by as many code points from the
    start of the next document in descending order of doc_id (a null doc_id is
    the least; after the last comes the first). Of documents with the same
    doc_id, the one with the least text is the next one of others; each gets a
    row of its own. A null text is as an empty one. Likeness is that of the
    fingerprints, nothing else; texts without words have equal ones. The rows of
    one doc_id are put in order in one task, so doc_id should be a key.

    Texts are dealt by doc_id once, with their sketches; what goes to a neighbour
    is the part of the text that it needs, and the sketch.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), text.alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    ids = following(keyed.groupBy("k").agg(F.max(third).alias("third")))
    full = keyed.select("k", "text", sketch(F.col("text"), fraction, shingle, least).alias("sketch"))

    # The first of each k is the one with none before it. A filter on a rank would be pushed below the shuffle, and it could not be shared.
    before = F.lag("k").over(Window.partitionBy("k").orderBy("text"))
    ahead = full.withColumn("__before", before).where("__before is null").select(
        F.col("k").alias("next_k"), F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"),
    )
    given = ahead.join(ids.withColumnRenamed("k", "to_k"), "next_k").select(
        "to_k", F.substring("next_text", F.lit(1), F.col("third")).alias("given"), "next_sketch"
    )
    both = full.join(given, F.col("k") == F.col("to_k")).select(
        "k", "text", "sketch", "next_sketch", F.char_length("text").alias("n_chars"), F.concat(
            F.substring("text", F.lit(1), F.char_length("text") - third), F.substring("given", F.lit(1), third)
        ).alias("edited")
    )
    both = both.select("*", sketch(F.col("edited"), fraction, shingle, least).alias("edited_sketch"))
    return both.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), fraction, least).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), fraction, least).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), fraction, least).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), fraction, least).alias("contained_next"),
    )
