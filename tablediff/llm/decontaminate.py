"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash

TERM = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
#: Items in a block, and blocks in a block of the next level.
BLOCK, FAN = 4, 64
#: Sums in another order may differ by so much.
SLACK = 1e-9
#: Words that question and answer are compared in.
GRAM = 3
#: Items of up to so many words are looked for in passages of one size; longer ones in passages of the next size, WIDER times as long, and so on.
SHORT, WIDER = 64, 4


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Item:
    item_id: int | None
    question: set[tuple[str, ...]]
    answer: set[tuple[str, ...]]
    n_words: int

    @classmethod
    def of(cls, item_id: int | None, text: str) -> Item:
        """The last sentence is the answer, what is before it the question; of a single sentence, its halves."""
        parts = [t for t in (terms(s) for s in SENTENCE.split(text)) if t]
        words = [w for p in parts for w in p]
        cut = len(words) - len(parts[-1]) if len(parts) > 1 else len(words) // 2
        return cls(item_id, _grams(words[:cut]), _grams(words[cut:]), len(words))


@dataclass
class Statistics:
    """What BM25 weights need of all items: their number, mean length, and in how many a term occurs."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[list[str]]) -> Statistics:
        sizes = [len(t) for t in texts]
        return cls(len(texts), sum(sizes) / max(1, len(texts)), Counter(w for t in texts for w in set(t)))


def reach(n_words: int) -> int:
    """The length of the class of an item, by its own words alone."""
    size = SHORT
    while size < n_words:
        size *= WIDER
    return size


class Index:
    """Items of one class of lengths, which are looked for in passages of twice that length.

    BM25 weights of the terms of items, each divided by its item's score for itself, so 1 is the most.

    Items are numbered and lie in blocks of BLOCK, FAN of which make a block of
    the next level, up to one. A term has its postings in order of the item, and
    its largest weight in each block of each level where it occurs. `known` are
    the statistics of all items where these are a part of them.
    """

    def __init__(self, rows: list[tuple[int | None, str]], known: Statistics | None = None):
        rows = [(i, t) for i, t in rows if terms(t)]
        self.items = [Item.of(i, t) for i, t in rows]
        counts = [Counter(terms(t)) for _, t in rows]
        known = known or Statistics.of([terms(t) for _, t in rows])
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(counts):
            weight = {
                w: math.log(1 + (known.n - known.df[w] + 0.5) / (known.df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * self.items[k].n_words / known.mean))
                for w, n in c.items()
            }
            own = sum(weight.values())
            for w, x in weight.items():
                postings[w].append((k, x / own))
        self.docs = {w: [k for k, _ in p] for w, p in postings.items()}
        self.weights = {w: [x for _, x in p] for w, p in postings.items()}
        self.most = {w: max(x) for w, x in self.weights.items()}
        # The levels, from the blocks of items to the last below a single block: for each term its blocks and largest weights.
        self.levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
        size = BLOCK
        while not self.levels or size < len(rows):
            self.levels.append({w: self._largest(p, size) for w, p in postings.items()})
            size *= FAN
        self.stride = max((reach(i.n_words) for i in self.items), default=SHORT)
        self.window = 2 * self.stride

    @staticmethod
    def _largest(postings: list[tuple[int, float]], size: int) -> tuple[np.ndarray, np.ndarray]:
        top: dict[int, float] = {}
        for k, x in postings:
            top[k // size] = max(x, top.get(k // size, 0.0))
        return np.array(list(top), np.int64), np.array(list(top.values()))

    def above(self, query: set[str], threshold: float) -> Iterator[tuple[int, float]]:
        """All items whose score for the query's terms (of the index) reaches the threshold, by block-max WAND.

        The sum of the terms' largest weights in a block bounds what its items
        can get. From the whole index down, a block below the threshold is
        passed over with all blocks in it, so these cost nothing.
        """
        if sum(map(self.most.__getitem__, query)) < threshold - SLACK:
            return
        open_, level = [(0, len(self.levels) - 1)], 0
        while open_:
            block, level = open_.pop()
            if level < 0:
                yield from self._search(block, query, threshold)
                continue
            found, bounds = self._inside(block, level, query)
            open_ += [(k, level - 1) for k in (found + np.flatnonzero(bounds >= threshold - SLACK)).tolist()]

    def _inside(self, block: int, level: int, query: set[str]) -> tuple[int, np.ndarray]:
        """The first of the blocks of `level` inside one of the next level, and the bound of each."""
        table = self.levels[level]
        if level == len(self.levels) - 1:
            parts = [table[w] for w in query]
            first = 0
        else:
            first, parts = block * FAN, []
            for blocks, most in map(table.__getitem__, query):
                a, b = np.searchsorted(blocks, (first, first + FAN))
                if a < b:
                    parts.append((blocks[a:b], most[a:b]))
        return first, np.bincount(np.concatenate([p[0] for p in parts]) - first, np.concatenate([p[1] for p in parts]))

    def _search(self, block: int, query: set[str], threshold: float) -> Iterator[tuple[int, float]]:
        """WAND in one block: the pivot is the first item that the terms up to it could lift to the threshold."""
        first, end = block * BLOCK, (block + 1) * BLOCK
        cursors = []  # item, place among the postings, term, largest weight in the block
        for w in query:
            docs = self.docs[w]
            place = bisect_left(docs, first)
            if place < len(docs) and docs[place] < end:
                blocks, largest = self.levels[0][w]
                most = float(largest[np.searchsorted(blocks, block)])
                cursors.append([docs[place], place, w, most])
        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=itemgetter(0))
            bound = 0.0
            for c in cursors:
                bound += c[3]
                if bound >= threshold - SLACK:
                    item = c[0]
                    break
            else:
                return
            if cursors[0][0] == item:
                score = sum(self.weights[w][place] for at, place, w, _ in cursors if at == item)
                if score >= threshold - SLACK:
                    yield item, score
                item += 1
            for c in cursors:
                if c[0] < item:
                    docs = self.docs[c[2]]
                    c[1] = bisect_left(docs, item, c[1])
                    c[0] = docs[c[1]] if c[1] < len(docs) else end

    def found(self, words: list[str], threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """For each item that a passage of a text's words holds: the largest score, and the overlaps of that passage.

        Passages overlap by half, so that each item of the index fits one whole.
        """
        out: dict[int, tuple[float, float, float]] = {}
        known = self.docs.keys()
        for at in range(0, max(1, len(words) - self.stride), self.stride):
            passage = words[at : at + self.window]
            grams = None
            for k, score in self.above(known & set(passage), threshold):
                grams = grams if grams is not None else {n: {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} for n in range(1, GRAM + 1)}
                question, answer = (self._share(part, grams) for part in (self.items[k].question, self.items[k].answer))
                if question >= overlap and answer >= overlap and score > out.get(k, (0,))[0]:
                    out[k] = (score, question, answer)
        return out

    @staticmethod
    def _share(part: set[tuple[str, ...]], grams: dict[int, set[tuple[str, ...]]]) -> float:
        return sum(g in grams[len(g)] for g in part) / len(part) if part else 1.0


class Shard:
    """Items of all lengths: an index for each class of them. What is found of an item depends on no other one but by the statistics."""

    def __init__(self, rows: list[tuple[int | None, str]], known: Statistics | None = None):
        rows = [(i, t) for i, t in rows if terms(t)]
        known = known or Statistics.of([terms(t) for _, t in rows])
        classes: dict[int, list] = defaultdict(list)
        for row in rows:
            classes[reach(len(terms(row[1])))].append(row)
        self.indexes = [Index(classes[n], known) for n in sorted(classes)]

    def found(self, text: str | None, threshold: float, overlap: float) -> Iterator[tuple[int | None, float, float, float]]:
        """(item_id, score, question, answer) of each item in the text."""
        words = terms(text)
        for index in self.indexes:
            for k, values in index.found(words, threshold, overlap).items():
                yield index.items[k].item_id, *values


def shards(benchmark: DataFrame, shard_bytes: int = 4 << 20) -> Iterator[Shard]:
    """Shards of all items of `benchmark` (item_id, text), each of about `shard_bytes` of text.

    The number follows from the size of the table, so that what is broadcast is
    bounded; documents are read once for each shard. All have the statistics of
    the whole table, so its size changes no score. An item longer than
    `shard_bytes` has a shard of its own size. Items without words, null ones
    too, are never found; repeated rows count once; an empty table gives one
    shard of nothing.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // shard_bytes))
    rows = lambda part: sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    if n_shards == 1:
        yield Shard(rows(items))
        return

    def split(batches):
        for batch in batches:
            found = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(t) for t in found], pa.int64()), pa.array([sorted(set(t)) for t in found], pa.list_(pa.string()))], ["n", "terms"]
            )

    cut = lambda part: part.mapInArrow(split, "n long, terms array<string>")
    n, mean = cut(items).where("n > 0").agg(F.count("*"), F.avg("n")).first()
    df = stash(cut(items).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    for k in range(n_shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)) == k)
        own = cut(part).select(F.explode("terms").alias("term")).distinct()
        yield Shard(rows(part), Statistics(n, mean, {r["term"]: r["df"] for r in df.join(own, "term", "left_semi").collect()}))


def searched(rows: DataFrame, parts: Iterator[Shard], search: Callable, schema: str) -> DataFrame:
    """search(shard, batches) over `rows` for every shard.

    A single shard's result is a plan as any other. Of several, each one's is
    written before the next is broadcast, so that tasks hold one at a time.
    """
    out, several = [], False
    for shard, ahead in pairwise(chain(parts, [None])):
        shared = rows.sparkSession.sparkContext.broadcast(shard)
        found = rows.mapInArrow(lambda batches, shared=shared: search(shared.value, batches), schema)
        if ahead is None and not several:
            return found
        several = True
        out.append(stash(found, "found"))
        shared.destroy()
    return reduce(DataFrame.union, out)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard_bytes: int = 4 << 20) -> DataFrame:
    """Which items of `benchmark` stand in which of `docs` (doc_id, text; other columns are ignored).

    A passage holds an item if its BM25 score is at least `threshold` of the
    item's score for itself, and at least `overlap` of the word triples of the
    item's question and of its answer occur in the passage. Case and marks do
    not count. Every passage of every whole text is tried, in sizes that follow
    from the item's own length; null and empty texts hold nothing. Returns one
    row for each document and item: doc_id, item_id, score, question_overlap,
    answer_overlap; repeated rows give repeated rows.
    """
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def search(shard, batches):
        for batch in slices(batches):
            found = [(i, *x) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for x in shard.found(text, threshold, overlap)]
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return searched(rows, shards(benchmark, shard_bytes), search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard_bytes: int = 4 << 20) -> DataFrame:
    """The rows of `docs` (text; all columns of any name are kept) whose text holds no item of `benchmark`, as contaminated() finds them.

    Null and empty texts stay, repeated rows stay or go together, and an empty
    table of documents or items gives the documents as they are. Texts are told
    by 128 bits of a hash; those that hold an item are few, and go by a join.
    """

    def clean(shard, batches, column, keep):
        for batch in slices(batches):
            texts = batch.column(column).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([(next(iter(shard.found(t, threshold, overlap)), None) is None) == keep for t in texts], pa.bool_()))

    parts = shards(benchmark, shard_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        place = docs.columns.index("text")
        return searched(docs, iter([first]), lambda shard, batches: clean(shard, batches, place, True), docs.schema)
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], F.unhex(F.md5(docs["text"].cast("string"))).alias("digest"))
    rows = docs.select(F.unhex(F.md5(F.col("text").cast("string"))).alias("digest"), F.col("text").cast("string").alias("text"))
    found = searched(rows, chain([first, second], parts), lambda shard, batches: clean(shard, batches, 1, False), "digest binary, text string")
    return keyed.join(found.select("digest").distinct(), "digest", "left_anti").select(*names).toDF(*docs.columns)
