"""Near-duplicates by the Jaccard similarity of shingle sets: banded minima, then the sets themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stash
from .graph import connected_components
from .simhash import links, majority, one_each, shingle_hashes

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in 100,000.
BANDS, ROWS = 26, 5
#: Shingles under all permutations at once; bounds the memory that a very long text takes.
PIECE = 1 << 11


def shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    pieces = [np.unique(h) for h in shingle_hashes(text, shingle, seed)]
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def multipliers(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least of `hashes` under each permutation."""
    least = np.full(len(by), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), PIECE):
        np.minimum(least, np.multiply.outer(by, hashes[at : at + PIECE]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (column >> np.uint64(29)) ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """16 bits of each minimum. Texts of a similarity agree in about that share of them, and seldom elsewhere."""
    mixed = (least ^ (least >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype("<u2").tobytes()


def fewest_shared(similarity: float) -> int:
    """Minima in which texts of the similarity agree but for one pair in billions (six and a half deviations)."""
    n = BANDS * ROWS
    return int(n * similarity - 6.5 * (n * similarity * (1 - similarity)) ** 0.5)


def text_digest(text: Column) -> Column:
    """128 bits of a text; texts with the same ones are taken as equal."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, h, digest, fp, keys, size, signature) of each row: two hashes of its text, op1's fingerprint, its bands, and its shingles' number and minima."""

    def run(batches):
        by = multipliers(seed)
        for batch in slices(batches):
            fps, keys, sizes, signatures = [], [], [], []
            for t in batch.column(3).cast(pa.binary()).to_pylist():
                fps.append(majority(shingle_hashes(t, 3, seed)))
                hashes = shingle_set(t, shingle, seed)
                least = minima(hashes, by)
                sizes.append(len(hashes))
                keys.append(band_keys(least) if len(hashes) else [])
                signatures.append(signature(least))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "h", "digest", "fp", "keys", "size", "signature"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text_digest(text).alias("digest"), text.alias("text")).mapInArrow(
        run, "doc_id long, h long, digest binary, fp long, keys array<long>, size int, signature binary"
    )


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(h, hashes) of the texts whose h is in `wanted`."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle, seed).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["h", "hashes"])

    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(wanted, "h", "left_semi")
    return rows.mapInArrow(run, "h long, hashes array<long>").dropDuplicates(["h"])


def _likely(pairs: DataFrame, keyed: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) that sizes and signatures leave; these are short, whatever the texts are."""
    least = fewest_shared(similarity)

    def run(batches):
        for batch in slices(batches, 8192):
            both = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for k in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array((both[0] == both[1]).sum(axis=1) >= least))

    side = lambda k: keyed.select(F.col("h").alias(k), F.col("size").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    return near.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, keyed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) whose sets reach the similarity. Sets are only brought to pairs that are likely to."""
    x = sets.select(F.col("h").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("h").alias("b"), F.col("hashes").alias("y"))
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    near = stash(_likely(pairs.distinct(), keyed, similarity), "likely")
    return stash(near.join(x, "a").join(y, "b").where(both >= similarity * (total - both) - 1e-9).select("a", "b"), "alike")


def jaccard_links(
    docs: DataFrame, keyed: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, bucket: int = 64
) -> DataFrame:
    """Links (a, b) between text hashes that connect all texts of `docs` that share a band and reach the similarity.

    `keyed` has h, keys, size and signature, a row for each text. Each text is
    first compared with one of those that it shares a bucket with, the same for
    all as far as possible, which links most groups of copies. A bucket of over
    `bucket` texts may hold a large group of near copies, and such a group fills
    many buckets: full buckets go together by a text that is in many of them, and
    the one next to what most of the texts share is compared with all others. What
    is not connected then is compared pair by pair, in full buckets the pairs
    that can reach the similarity.
    """
    keys = keyed.select("h", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("first")).where("n > 1")
    keys = stash(keys.join(sizes, "key"), "bands")
    sets = stash(_sets(docs, keys.select("h").distinct(), shingle, seed), "shingles")
    one = keys.groupBy(F.col("h").alias("b")).agg(F.min("first").alias("a")).where("a <> b")  # a pair for each text, whatever its buckets hold
    found = _alike(one.select("a", "b"), keyed, sets, similarity)

    def still_mixed(keys: DataFrame) -> DataFrame:
        """The buckets with texts that no links connect yet, and the root of each text."""
        roots = connected_components(found)
        rooted = keys.join(roots, F.col("h") == F.col("node"), "left").select("key", "n", "h", F.coalesce("root", "h").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
        return stash(rooted.join(mixed, "key"), "bands")

    mixed = still_mixed(keys)
    full = mixed.where(F.col("n") > bucket).select("key", "n", "h")
    held = None
    if not full.isEmpty():
        held = stash(_from_core(stash(_gathered(full), "gathered"), sets, similarity), "held")
        star = held.join(held.groupBy("key").agg(F.min_by("h", F.struct("off", "h")).alias("a")), "key").where("a <> h")
        found = found.union(_alike(star.select("a", F.col("h").alias("b")), keyed, sets, similarity))
        mixed = still_mixed(mixed.select("key", "n", "h"))
    few = mixed.where(F.col("n") <= bucket)
    side = lambda k: few.select("key", F.col("h").alias(k), F.col("root").alias(f"root_{k}"))
    pairs = side("a").join(side("b"), "key").where("a < b and root_a <> root_b").select("a", "b")
    found = found.union(_alike(pairs, keyed, sets, similarity))
    return found if held is None else found.union(_alike(_apart(held, connected_components(found)), keyed, sets, similarity))


def _gathered(full: DataFrame) -> DataFrame:
    """(key, h) of the texts of full buckets (key, n, h), the buckets gathered under the text (key) that leads them.

    A bucket is led by the one of its texts whose buckets hold most, and then by
    the leader of most among those of all buckets that its texts are in. So the
    buckets of a large group of near copies come together, and each of its texts
    counts once, not once for each band; texts that share a bucket share a group.
    """
    top = lambda rows, by: rows.groupBy(by).agg(F.max(F.struct("w", "lead")).alias("top")).select(by, "top.w", "top.lead")
    keys = full.select("key", "h")
    leads = top(keys.join(full.groupBy("h").agg(F.sum("n").alias("w")).withColumn("lead", F.col("h")), "h"), "key")
    leads = top(keys.join(top(keys.join(leads, "key"), "h"), "h"), "key")
    return keys.join(leads, "key").select(F.col("lead").alias("key"), "h").distinct()


def _from_core(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The texts of groups (key, h), with what they have otherwise than the group's core: the shingles in over half of its texts.

    size: of the set; odd: the shingles in one of set and core only; off: their
    number, less what a pair of that size may differ in. Two sets differ in what
    is odd to one of them only, so a pair reaches the similarity if and only if
    it shares (off + off) / 2 odd shingles.
    """
    lead = sets.select(F.col("h").alias("key"), F.col("hashes").alias("lead"))
    between = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
    members = groups.join(sets, "h").join(lead, "key").select("key", "h", F.size("hashes").alias("size"), between("hashes", "lead").alias("odd"))
    members = stash(members, "members")
    items = members.select("key", F.explode("odd").alias("item")).groupBy("key", "item").agg(F.count("*").alias("m"))
    often = items.join(groups.groupBy("key").agg(F.count("*").alias("n")), "key").where("2 * m > n")
    often = often.groupBy("key").agg(F.collect_list("item").alias("often"))  # what core and leader differ in, under three times the mean set
    members = members.join(often, "key", "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
    members = members.select("key", "h", "size", between("odd", "often").alias("odd"))
    return members.withColumn("off", F.size("odd") - F.col("size") * ((1 - similarity) / (1 + similarity)))


def _apart(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a < b) of a group that no links connect yet and that can reach the similarity.

    Those whose off + off is at most 0 reach it, and so does each of them with the
    text of the least off, which is compared with all; so they are connected. All
    others share an odd shingle. With these in one order for all texts of a group,
    the rarest first, a pair that shares k has the first of them among the first
    size - k + 1 of each. What only connected texts have comes before all, as no
    pair needs it. Pairs within the group's largest component are not formed.
    """
    placed = held.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h"))
    by_root = placed.groupBy("key", "root").agg(F.min("off").alias("off"), F.count("*").alias("n"))
    nearest, largest = F.min_by("root", F.struct("off", "root")), F.max_by("root", F.struct("n", "root"))
    mixed = by_root.groupBy("key").agg(nearest.alias("nearest"), F.min("off").alias("least"), largest.alias("main"), F.count("*").alias("k")).where("k > 1")
    second = by_root.join(mixed, "key").where("root <> nearest").groupBy("key").agg(F.min("off").alias("second"))
    placed = placed.join(mixed.join(second, "key"), "key")
    other = F.when(F.col("root") == F.col("nearest"), F.col("second")).otherwise(F.col("least"))  # the least off of another component
    shared = F.greatest(F.lit(1), F.ceil((F.col("off") + other) / 2 - 1e-6))
    placed = placed.select("key", "h", "root", "odd", "off", (F.col("root") != F.col("main")).alias("aside"), (F.size("odd") - shared + 1).alias("first"))
    placed = stash(placed.where("first > 0"), "placed")
    items = placed.select("key", "h", "root", "off", "aside", "first", F.size("odd").alias("all"), F.explode("odd").alias("item"))
    held_by = items.groupBy("key", "item").agg(F.count("*").alias("m"), (F.min("root") != F.max("root")).alias("mixed"))
    order = Window.partitionBy("key", "h").orderBy("mixed", "m", "item")
    items = items.join(held_by, ["key", "item"]).withColumn("left", F.col("all") - F.row_number().over(order) + 1)  # of all, from this one on
    items = stash(items.where("mixed and left > all - first").select("key", "item", "h", "root", "off", "aside", "left"), "odd")
    side = lambda df, x: df.select("key", "item", *[F.col(c).alias(f"{c}_{x}") for c in ("h", "root", "off", "aside", "left")])
    pairs = side(items.where("aside"), "a").join(side(items, "b"), ["key", "item"]).where("root_a <> root_b and (not aside_b or h_a < h_b)")
    pairs = pairs.where(2 * F.least("left_a", "left_b") + 1e-6 >= F.col("off_a") + F.col("off_b"))
    return pairs.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, bucket: int = 64) -> DataFrame:
    """One row of `docs` (doc_id, text; other columns of any name are kept) for each group of near-duplicates.

    Linked are texts whose sets of `shingle` words have at least the Jaccard
    similarity, and texts that op1_simhash links (three words, 2 of 64 bits). Of
    a group the row with the least doc_id stays (null is the last), of several
    texts with that doc_id the one with the least hash. Texts without words, null
    and empty ones too, are one group, as their fingerprints are equal. Rows that
    share doc_id and text give one. An empty table gives none.
    """
    rows = stash(_keyed(docs, shingle, seed), "keyed")
    texts = stash(rows.drop("doc_id").dropDuplicates(["h"]), "texts")
    prints = texts.groupBy("fp").agg(F.min("h").alias("least"))
    a, b = (prints.select(F.col("fp").alias(c), F.col("least").alias(f"h_{c}")) for c in "ab")
    bits = links(prints.select("fp"), 2, bucket).join(a, "a").join(b, "b").select("h_a", "h_b")
    same = texts.join(prints, "fp").where("h <> least").select("h", "least")
    jaccard = jaccard_links(docs, texts, shingle, similarity, seed, bucket)
    roots = connected_components(jaccard.union(same).union(bits).toDF("a", "b"))
    placed = texts.select("h", "digest").join(roots, F.col("h") == F.col("node"), "left").select("h", "digest", F.coalesce("root", "h").alias("root"))
    return one_each(docs, rows.select("doc_id", "h", "digest"), placed)
