"""SimHash near-duplicates: pigeonhole blocks, then the exact Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash
from .graph import connected_components

BITS = 64
#: Shingles hashed at once; bounds the memory that a very long text takes.
PIECE = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of `shingle` words, repeats included, in pieces of at most PIECE."""
    words = (text or b"").lower().split()  # both keep to ASCII
    if not words:
        return
    size = min(shingle, len(words))
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    one = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, PIECE):
        spans = zip(starts[at : at + PIECE], starts[at + size : at + size + PIECE])
        yield np.array([one(joined[a : b - 1], seed) for a, b in spans], dtype=np.uint64)


def majority(pieces: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; zero for none."""
    ones, n = np.zeros((8, 8), dtype=np.int64), 0
    lane = np.uint64(0x0101010101010101)
    for h in pieces:
        n += len(h)
        cuts = np.arange(0, len(h), 255)  # so many ones fit a byte
        for bit in range(8):
            sums = np.add.reduceat((h >> np.uint64(bit)) & lane, cuts)
            ones[:, bit] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).reshape(-1), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of each row; rows without words get 0."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = [majority(shingle_hashes(t, shingle, seed)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _blocks(distance: int) -> list[list[int]]:
    """The bits are cut into distance + 2 blocks; a pair within the distance agrees in two of them at least."""
    n = distance + 2
    return [list(range(BITS * i // n, BITS * (i + 1) // n)) for i in range(n)]


def links(fps: DataFrame, distance: int = 2, bucket: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all those within `distance` bits.

    Each fingerprint has one key for every two blocks. Buckets of up to `bucket`
    fingerprints are joined with themselves and each pair verified. A fuller
    bucket may hold a large group of near copies: there each fingerprint goes to
    the centres within half the distance of it, and is linked with the least of
    the fingerprints at each centre. Any two within the distance share a
    centre, and all that share one are within the distance, so the groups come
    out whole without all pairs of the bucket. This needs an even distance.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    blocks = _blocks(distance)
    pairs = list(combinations(range(len(blocks)), 2))
    mask = [sum(1 << b for b in blocks[i] + blocks[j]) for i, j in pairs]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    keys = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in mask])).alias("which", "part"),
    )
    sizes = keys.groupBy("which", "part").agg(F.count("*").alias("n")).where("n > 1")
    keys = stash(keys.join(sizes, ["which", "part"]), "simhash-keys")

    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    few = keys.where(F.col("n") <= bucket)
    cold = few.select("which", "part", F.col("fp").alias("a")).join(
        few.select("which", "part", F.col("fp").alias("b")), ["which", "part"]
    ).where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")

    full = keys.where(F.col("n") > bucket)
    reach = distance // 2
    flips = F.lit(None)
    for k, (i, j) in reversed(list(enumerate(pairs))):
        free = [b for n, block in enumerate(blocks) if n not in (i, j) for b in block]
        masks = [0] + [reduce(lambda x, y: x | 1 << y, c, 0) for r in range(1, reach + 1) for c in combinations(free, r)]
        flips = F.when(F.col("which") == k, F.lit([signed(m) for m in masks]).cast("array<long>")).otherwise(flips)
    at = full.select("which", "part", "fp", F.explode(flips).alias("flip")).select(
        "which", "part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")
    )
    least = at.groupBy("which", "part", "centre").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1")
    hot = at.join(least.drop("m"), ["which", "part", "centre"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return cold.union(hot).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42, bucket: int = 64) -> DataFrame:
    """Near-duplicate groups of `docs` (doc_id, text; other columns are ignored).

    Returns one row for each row of docs: doc_id, fingerprint (16 lower-case hex
    digits), component_id (the least doc_id that links reach). Texts that are
    null, empty or only white space have fingerprint zero and are linked as any
    other. Repeated rows give repeated rows. A null doc_id stays null and never
    names a component unless all of its members are null. An empty table gives none.
    """
    fps = stash(fingerprints(docs, shingle, seed), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(distinct.select("fp"), distance, bucket))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs` for each group: that with the least doc_id (null is the last), then the least text hash.

    Only rows of the same group go, whatever doc_id they share or lack.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), F.unhex(F.md5(text)).alias("digest"))
    groups = simhash_groups(docs.select(F.xxhash64(text).alias("doc_id"), "text"), **options)
    groups = groups.select(F.col("doc_id").alias("h"), F.col("component_id").alias("root")).dropDuplicates(["h"])
    return one_each(docs, rows, rows.groupBy("h").agg(F.min("digest").alias("digest")).join(groups, "h"))


def one_each(docs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The row of `docs` with the least doc_id (null last), then text hash, for each root.

    `rows` has doc_id, h and digest (64 and 128 bits of the text) of each row of
    docs; `texts` has h, digest and root, one row for each h. A text whose digest
    is not that of its h is another text with the same 64 bits, and a group of
    its own. Rows that share doc_id and text give one of them. Columns of any
    name are kept.
    """
    owner = texts.select("h", F.col("digest").alias("own"), "root")
    placed = rows.join(owner, "h").withColumn("odd", F.when(F.col("digest") != F.col("own"), F.col("digest")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "digest")).alias("first")
    ids = placed.groupBy("root", "odd").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("key"), F.col("first.digest").alias("mark"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = docs["text"].cast("string")
    keyed = docs.select(
        *[docs[c].alias(n) for c, n in zip(docs.columns, names)], docs["doc_id"].cast("long").alias("i"), F.xxhash64(text).alias("h"), F.unhex(F.md5(text)).alias("digest")
    )
    same = F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")) & F.col("digest").eqNullSafe(F.col("mark"))
    return keyed.join(ids, same, "left_semi").dropDuplicates(["i", "h", "digest"]).select(*names).toDF(*docs.columns)
