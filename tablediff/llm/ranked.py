"""Ranked lexical search: the best documents for each item, exactly, by a threshold-seeded join.

1. Documents become rows of their terms that occur in items, with their counts;
   these are written once. Each such term gets its weight, and the largest and
   the kth largest impact that it has in any document.
2. The kth impacts seed a threshold: k documents score at least as much for an
   item as the largest kth impact among its terms, so nothing below can be among
   its best k. In order of their largest impacts, the first terms of an item are
   those that together stay below the threshold; a document needs one of the
   others (the essential ones) to reach it.
3. Documents are joined to the items of their essential terms. A pair stays a
   candidate if its essential impacts and the most that the other terms can add
   reach the threshold, or the kth best score found in the same task so far. All
   impacts of the candidates are then summed exactly.

Items are dealt to shards of bounded size; each is searched by a job of its own
over the written rows, so what is broadcast at once is bounded however many
items there are, and no item's result depends on its shard.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stash

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of the items' terms up to which documents are reduced to them while they are read; beyond, by a join.
KNOWN_BYTES = 16 << 20
#: Terms of items in a shard, repeats in other items included; an item with more has a shard of its own.
SHARD_TERMS = 1 << 20
#: Pairs of documents and items that are scored at once.
CELLS = 1 << 22
#: Sums of whole numbers below this are exact in doubles.
EXACT = 2**53


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; A-Z are lower-cased, nothing else is."""
    return TERM.findall(text.lower()) if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the different terms of each different row of `items` (item_id, text). item is a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(set(terms(t))) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            lists = pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["item", "item_id", "terms"])

    text = F.col("text").cast("string")
    rows = items.select(F.sha2(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(":"), text), 256).alias("item"), F.col("item_id").cast("long"), text.alias("text"))
    return rows.where("text is not null").distinct().mapInArrow(run, "item string, item_id long, terms array<string>").select(
        "item", "item_id", F.explode("terms").alias("term")
    )


def counted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, n, terms, counts) of each row of `docs` with any term: how many it has, and those of `known` (term) with their counts.

    The terms of items are handed to the tasks if they are few; else all terms stay, and a later join drops the rest.
    """
    size = known.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    wanted = docs.sparkSession.sparkContext.broadcast({r[0].encode() for r in known.collect()}) if size <= KNOWN_BYTES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted and wanted.value.__contains__
        for batch in slices(batches):
            ids, sizes, names, counts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = terms(text)
                if found:
                    c = Counter(filter(keep, found) if keep else found)
                    ids.append(i)
                    sizes.append(len(found))
                    names.append(list(c))
                    counts.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<string>, counts array<long>")


@dataclass
class Shard:
    """Items and their terms, as arrays. Terms are numbered; `first` and `items` list the items of each, essential ones apart."""

    number: dict[str, int]
    weight: np.ndarray
    essential: tuple[np.ndarray, np.ndarray]
    other: tuple[np.ndarray, np.ndarray]
    threshold: np.ndarray
    rest: np.ndarray
    names: list[tuple[str, int | None]]

    @classmethod
    def of(cls, rows: list) -> Shard:
        """From rows (item, item_id, term, weight, most, essential, threshold)."""
        names = sorted({(r["item"], r["item_id"]) for r in rows}, key=lambda x: x[0])
        place = {item: k for k, (item, _) in enumerate(names)}
        number = {t: k for k, t in enumerate(sorted({r["term"] for r in rows}))}
        weight = np.zeros(len(number), np.int64)
        threshold, rest, most = (np.zeros(len(names), np.int64) for _ in range(3))
        lists: tuple[list, list] = ([], [])
        for r in rows:
            t, k = number[r["term"]], place[r["item"]]
            weight[t], threshold[k] = r["weight"], r["threshold"]
            most[k] += r["most"]
            rest[k] += 0 if r["essential"] else r["most"]
            lists[not r["essential"]].append((t, k))
        if len(most) and most.max() >= EXACT:
            raise OverflowError("the terms of an item have larger impacts than are summed exactly")
        grouped = []
        for pairs in lists:
            both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            grouped.append((np.searchsorted(both[:, 0], np.arange(len(number) + 1)), both[:, 1]))
        return cls(number, weight, *grouped, threshold, rest, names)

    def sums(self, group: tuple[np.ndarray, np.ndarray], doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """The sum of the impacts of each document (row) for each item (column) of a group of terms."""
        first, items = group
        many = first[term + 1] - first[term]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - first[term], many)
        cell = np.repeat(doc, many) * len(self.names) + items[at]
        return np.bincount(cell, np.repeat(impact, many).astype(np.float64), n_docs * len(self.names)).reshape(n_docs, -1)


class Best:
    """The k best (score, document) of each item so far: highest first, equal ones by doc_id, null first."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.item, self.score, self.doc, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        item, score, doc, known = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, known, -score, item))
        item, score, doc, known = (a[order] for a in (item, score, doc, known))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        kept = place < self.k
        self.item, self.score, self.doc, self.known = (a[kept] for a in (item, score, doc, known))


def search(counts: DataFrame, shard: Shard, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): at least the k best documents of each item of the shard; each task gives its own best."""
    shared = counts.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        best = Best(len(shard.names), k)
        numbers = pa.array(list(shard.number), pa.string())
        for batch in slices(batches, max(1, min(2048, CELLS // max(1, len(shard.names))))):
            lists = batch.column(2)
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.index_in(lists.flatten(), numbers)
            held = term.is_valid().to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)[held]
            doc, term = doc[held], term.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[held]
            m = 50 + (50 * batch.column(1).to_numpy(zero_copy_only=False) * n_docs) // n_terms
            impact = shard.weight[term] * ((10**9 * tf) // (1000 * tf + 20 * m[doc]))
            sums = shard.sums(shard.essential, doc, term, impact, batch.num_rows)
            need = np.maximum(np.maximum(shard.threshold, best.least), 1)
            open_ = (sums > 0) & (sums + shard.rest >= need)
            wanted = open_.any(axis=1)
            few = wanted[doc]
            sums = sums + shard.sums(shard.other, doc[few], term[few], impact[few], batch.num_rows)
            at, item = np.nonzero(open_ & (sums >= need))
            ids = batch.column(0)
            best.add(item, sums[at, item].astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)[at], ids.is_valid().to_numpy(zero_copy_only=False)[at])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard.names[i][0] for i in best.item], pa.string()), pa.array([shard.names[i][1] for i in best.item], pa.int64()),
                pa.array(best.doc, pa.int64(), mask=~best.known), pa.array(best.score, pa.int64()),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    return counts.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item string, item_id long, doc_id long, score long")


def weights(counts: DataFrame, known: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, weight, most, kth) of each known term that occurs: its weight, and its largest and kth largest impact (0 if in fewer documents)."""
    each = counts.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("n", F.col("e.terms").alias("term"), F.col("e.counts").alias("tf")).join(known, "term")
    df = stash(each.groupBy("term").agg(F.count("*").alias("df")), "terms")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    m = f"50 + (50 * n * {n_docs}) div {n_terms}"
    each = each.join(df.select("term", weight.alias("weight")), "term").select("term", "weight", F.expr(f"weight * ((1000000000 * tf) div (1000 * tf + 20 * ({m})))").alias("impact"))
    # Each task sorts out its own k largest before they are shuffled.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    top = each.withColumn("place", place).where(F.col("place") <= k)
    return top.groupBy("term", "weight").agg(F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))


def pruned(held: DataFrame, impacts: DataFrame) -> DataFrame:
    """Adds to (item, item_id, term) weight, most, the item's threshold, and whether the term is essential."""
    rows = held.join(impacts, "term")
    own = Window.partitionBy("item")
    upto = F.sum("most").over(own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    threshold = F.max("kth").over(own)
    return rows.select("item", "item_id", "term", "weight", "most", threshold.alias("threshold"), (upto >= threshold).alias("essential"))


def best_documents(docs: DataFrame, items: DataFrame, k: int = 50, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The k highest-scoring documents of each item, of those that score above 0: item_id, rank, doc_id, score.

    `docs` has doc_id and text, `items` item_id and text; other columns are
    ignored. A document without terms, as a null or empty one, is none. Each row
    of `docs` is a document of its own. Repeated rows of `items` count once;
    different texts with the same item_id are ranked one by one. Equal scores are
    in order of doc_id, null first.
    """
    held = stash(item_terms(items), "items")
    known = held.select("term").distinct()
    counts = stash(counted(docs, known), "counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = stash(pruned(held, weights(counts, known, n_docs, max(1, n_terms), k)), "impacts")
    # Items of the same shard are bound together; how many terms each shard has is counted first.
    shards = max(1, -(-rows.count() // shard_terms))
    shard = F.pmod(F.xxhash64("item"), F.lit(shards))
    found = []
    for s in range(shards):
        part = Shard.of(rows.where(shard == s).collect())
        found.append(stash(search(counts, part, n_docs, max(1, n_terms), k), "found"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    every = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return every.where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL for op12_ranked.
SQL = r"""
WITH words AS (SELECT doc_id, n, t.term, count(*) AS tf FROM (
        SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)) t
    GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM (SELECT doc_id, any_value(n) AS n FROM words GROUP BY doc_id)),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM words, totals GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM items JOIN words USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0) WHERE place <= 50
"""
