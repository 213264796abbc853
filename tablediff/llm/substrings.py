"""Substring dedup: windows of words that start earlier in the corpus, found with suffix automata.

Automata of the whole corpus, broadcast to every document, would take work that
grows with the square of the corpus, and a Python automaton takes about a
kilobyte a word. So the reference is cut to what recurs, and dealt to shards:

1. Every window of `least` words is owned by its anchor, the run of words in it
   with the least hash (the leftmost of ties). The anchor depends on the
   window's words only, so all occurrences of a window have the same one. The
   consecutive windows with the same anchor are a passage. Passages whose anchor
   occurs once in the corpus hold no repeats.
2. Of passages with equal words only the first can be new; the others are repeats.
   A document gives one row for each of its different passages, with all places.
3. The first ones, where different passages share an anchor, go to the shard of
   their anchor. It reads them in order of the corpus, matches each against the
   suffix automaton of the earlier ones, and adds it: where the matching
   statistic reaches `least`, a window started earlier. For an anchor in many
   different passages, their windows are grouped by their words instead.

Words that are equal are told by 128 bits of BLAKE2b of their bytes, in which no
two different sequences are known to agree.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

NO_ID = -(2**63)
BASE = np.uint64(0x9E3779B97F4A7C17)  # odd, and odd after halving BASE - 1
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: A passage's place is its first word times RUN plus its number of windows.
RUN = 1 << 10


class Powers:
    """Powers of BASE and its inverse, as far as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 2 * n
            for name, base in (("up", BASE), ("down", INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def digests(words: list[bytes], first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Two numbers (rows of an array) for each run of words from `first` to before `stop`: BLAKE2b of them, joined by spaces."""
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    made = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(starts[first].tolist(), (ends[stop - 1] - 1).tolist())]
    return np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)


def passages(words: list[bytes], least: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The different passages of a text: their anchors, digests, and all places of each, in order."""
    n, k = len(words), max(1, least // 3)
    if n < least:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), []
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up, down = powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    span = lambda a, b: _mixed((sums[b] - sums[a]) * down[a])
    at = np.arange(n - k + 1)
    grams = span(at, at + k)
    width = least - k + 1
    least_at = np.empty(n - least + 1, np.int64)
    view, step = sliding_window_view(grams, width), 1 << 16
    for i in range(0, len(view), step):
        least_at[i : i + step] = view[i : i + step].argmin(axis=1)
    least_at += np.arange(len(least_at))
    first = np.flatnonzero(np.diff(least_at, prepend=-1))
    stop = np.append(first[1:], len(least_at))
    anchors, found = grams[least_at[first]].view(np.int64), digests(words, first, stop + least - 1)
    places: dict[tuple[int, int], list[int]] = {}
    for key, place in zip(map(tuple, found.tolist()), (first * RUN + (stop - first)).tolist()):
        places.setdefault(key, []).append(place)
    if len(places) < len(first):
        at = {key: k for k, key in reversed(list(enumerate(map(tuple, found.tolist()))))}
        kept = [at[key] for key in places]
        anchors, found = anchors[kept], found[kept]
    return anchors, found, list(places.values())


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: bytes) -> int:
        q = self.next[p].get(w)
        if q is not None:  # an earlier sequence has it
            return q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[p] + 1)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, words: list[bytes]) -> list[int]:
        """The matching statistics: for each word, the length of the longest known sequence that ends with it."""
        out, state, length = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if (to := self.next[state].get(w)) is not None:
                state, length = to, length + 1
            out.append(length)
        return out


PASSAGE = "id long, h long, anchor long, w1 long, w2 long, places array<long>"


def repeated_ranges(docs: DataFrame, least: int, shard: int, hot: int) -> DataFrame:
    """(id, h, places) of what starts earlier in `docs` (id, h, text): a place is a word times RUN plus a number of windows from it on."""

    def cut(batches):
        powers = Powers()
        for batch in batches:
            ids, hs, texts = batch.columns[0], batch.columns[1], batch.column(2).cast(pa.binary())
            for i in range(0, batch.num_rows, 256):
                found = [passages((t or b"").split(), least, powers) for t in texts.slice(i, 256).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                words = np.concatenate([f[1] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, 256).take(row), hs.slice(i, 256).take(row), pa.array(np.concatenate([f[0] for f in found])),
                        pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), pa.array([p for f in found for p in f[2]], pa.list_(pa.int64())),
                    ],
                    ["id", "h", "anchor", "w1", "w2", "places"],
                )

    every = docs.mapInArrow(cut, PASSAGE)
    # Written first: a join of two plain shuffles is one that Spark can split where an anchor is very common.
    often = stash(every.groupBy("anchor").agg(F.sum(F.size("places")).alias("m")).where("m > 1").select("anchor"), "anchors")
    some = stash(every.join(often, "anchor", "left_semi"), "passages")

    where = F.struct("id", "h", F.get("places", F.lit(0)).alias("place"))
    firsts = stash(some.groupBy("w1", "w2").agg(F.min(where).alias("first"), F.first("anchor").alias("anchor")), "passages")
    rest = F.when(where == F.col("first"), F.slice("places", F.lit(2), F.size("places"))).otherwise(F.col("places"))
    again = some.join(firsts.select("w1", "w2", "first"), ["w1", "w2"]).select("id", "h", rest.alias("places")).where("size(places) > 0")

    variants = stash(firsts.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1"), "anchors")
    total = variants.agg(F.coalesce(F.sum("variants"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    open_ = firsts.join(variants, "anchor").select("first.*", "anchor", (F.col("variants") > hot).alias("hot"))
    wanted = open_.groupBy("id", "h").agg(F.collect_list(F.struct("place", "anchor", "hot")).alias("wanted"))  # bounded by the document

    def fetch(batches):
        for batch in batches:
            ids, hs, texts, wanted = (batch.column(k) for k in ("id", "h", "text", "wanted"))
            for at in range(0, batch.num_rows, 256):
                rows = []
                for i in range(at, min(at + 256, batch.num_rows)):
                    words, key = texts[i].as_py().encode().split(), (ids[i].as_py(), hs[i].as_py())
                    for r in wanted[i].as_py():
                        start, n = divmod(r["place"], RUN)
                        rows.append((*key, start, n, r["anchor"], r["hot"], b" ".join(words[start : start + n + least - 1])))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.binary())],
                    ["id", "h", "start", "n", "anchor", "hot", "passage"],
                )

    texts = docs.join(wanted, ["id", "h"]).mapInArrow(
        fetch, "id long, h long, start long, n long, anchor long, hot boolean, passage binary"
    )
    # Repeated rows are one document, so a place comes once; their passages would else match themselves.
    texts = stash(texts.dropDuplicates(["id", "h", "start"]), "passages")

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "h", "start"])
        automaton, out = SuffixAutomaton(), []
        for i, h, start, passage in zip(group["id"], group["h"], group["start"], group["passage"]):
            words = passage.split()
            ends = [end for end, length in enumerate(automaton.matches(words)) if length >= least]
            if ends:
                out.append((i, h, [(start + end - least + 1) * RUN + 1 for end in ends]))
            automaton.add(words)
        return pd.DataFrame(out, columns=["id", "h", "places"])

    cold = texts.where("not hot").withColumn("shard", F.pmod("anchor", F.lit(shards)))
    cold = cold.groupBy("shard").applyInPandas(match, "id long, h long, places array<long>")

    def windows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, hs, starts, ns, passages = (part.column(c) for c in ("id", "h", "start", "n", "passage"))
                counts = ns.to_numpy()
                row = pa.array(np.repeat(np.arange(part.num_rows), counts))
                within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                keys = [digests(p.split(), np.arange(n), np.arange(n) + least) for p, n in zip(passages.to_pylist(), counts.tolist())]
                keys = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hs.take(row), pa.array(starts.take(row).to_numpy() + within), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())],
                    ["id", "h", "start", "w1", "w2"],
                )

    single = texts.where("hot").mapInArrow(windows, "id long, h long, start long, w1 long, w2 long")
    here = F.struct("id", "h", "start")
    # Written for the same reason as the anchors.
    earliest = stash(single.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "windows")
    very = single.join(earliest, ["w1", "w2"]).where(here != F.col("first")).select("id", "h", F.array(F.col("start") * RUN + 1).alias("places"))
    return again.union(cold).union(very)


def substring_dedup(docs: DataFrame, least: int = 20, shard: int = 2000, hot: int = 64) -> DataFrame:
    """Removes from `docs` (doc_id, text; other columns are ignored) words in windows of `least` words that start earlier.

    Earlier is by doc_id (null first), then by place; of different texts with the
    same doc_id, by a hash. Rows that share doc_id and text are one document and
    get the same result. Windows are judged on the input. Words are split at
    ASCII white space; texts that are null, empty or shorter than a window are
    kept. Returns doc_id, n_words, n_removed, kept (the words that stay, joined
    by one space).

    shard: passages that one automaton takes, about. hot: an anchor in more
    different passages has its windows grouped by Spark instead.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    once = stash(repeated_ranges(rows, least, shard, hot), "ranges")
    ranges = once.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("ranges"))  # bounded by the document

    def remove(batches):
        for batch in batches:
            out = []
            for i, text, ranges in zip(*(batch.column(k) for k in ("id", "text", "ranges"))):
                words = text.as_py().encode().split()
                gone = 0
                if ranges.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    start, n = np.divmod(ranges.values.to_numpy(), RUN)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + n + least - 1, -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered) if not c]
                i = i.as_py()
                out.append((None if i == NO_ID else i, len(words) + gone, gone, b" ".join(words).decode()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return rows.join(ranges, ["id", "h"], "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


#: op3 in DuckDB SQL, for documents whose doc_id is a key.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM d)),
again AS (SELECT doc_id, start FROM windows QUALIFY rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, start) > 1),
gone AS (SELECT DISTINCT doc_id, start + k AS place FROM again, range(20) AS r(k)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.place = gone.place GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
