import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablediff.llm import ranked

from .cases import DOCS_SCHEMA, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    """rows: (doc_id, text) of each document; items: distinct (item_id, text). Sorted (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c, size in counts:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def zipf(rnd, n, words=400):
    return " ".join(f"w{int(words * rnd.random() ** 3)}" + rnd.choice(["", "", ",", ".", "É", "_x"]) for _ in range(n))


@pytest.mark.parametrize("shard_terms", [1 << 20, 40])
def test_against_brute_force(spark, shard_terms):
    rnd = random.Random(3)
    texts = [zipf(rnd, rnd.choice([3, 20, 60, 200, 600])) for _ in range(400)]
    texts += [texts[0]] * 20 + ["W1 w1 W2", "ÀB àB Àb", "!!!"]
    df = docs(spark, *texts)
    items = [(i, zipf(rnd, rnd.choice([1, 4, 30]))) for i in range(25)] + [(100, "ÀB w1-w2"), (101, "nowhere"), (102, "w0 w0"), (None, "w1 w300"), (104, "...")]
    table = spark.createDataFrame([*items, items[0], (105, None)], "item_id long, text string").withColumn("term", F.lit("clash"))
    got = sorted((tuple(r) for r in ranked.best_documents(df, table, k=10, shard_terms=shard_terms).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], items, 10)


def test_prunes_and_seeds(spark):
    rnd = random.Random(5)
    rows = docs(spark, *[zipf(rnd, 50) + (" rare uncommon" if i % 40 == 0 else "") for i in range(1200)], extra=False)
    items = spark.createDataFrame([(1, "rare uncommon w0 w1 w2")], "item_id long, text string")
    held = ranked.item_terms(items)
    counts = ranked.counted(rows, held.select("term"))
    n, total = counts.agg(F.count("*"), F.sum("n")).first()
    impacts = ranked.weights(counts, held.select("term").distinct(), n, total, 10)
    assert "WindowGroupLimit" in impacts._jdf.queryExecution().toString()
    found = {r.term: r for r in ranked.pruned(held, impacts).collect()}
    assert found["rare"].essential and not found["w0"].essential
    assert found["rare"].threshold > found["w0"].most


def test_all_terms_without_a_broadcast(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [zipf(rnd, 40) for _ in range(50)]
    items = spark.createDataFrame([(i, zipf(rnd, 5)) for i in range(5)], "item_id long, text string")
    df = docs(spark, *texts)
    first = sorted(map(tuple, ranked.best_documents(df, items, k=5).collect()))
    monkeypatch.setattr(ranked, "KNOWN_BYTES", 1)
    assert sorted(map(tuple, ranked.best_documents(df, items, k=5).collect())) == first


def test_empty(spark):
    none, items = spark.createDataFrame([], DOCS_SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.best_documents(none, items).count() == 0
    assert ranked.best_documents(docs(spark, "a b"), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.best_documents(docs(spark, "a b", "", extra=False), items).collect()] == [(1, 1, 0)]
