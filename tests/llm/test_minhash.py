import itertools
import random

import pytest

import corpus_pipeline

from .cases import docs
from .test_simhash import fingerprint


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """The indexes of `rows` (doc_id, text) by group."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, fps = [shingles(t) for _, t in rows], [fingerprint(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        alike = sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        if alike or bin(fps[a] ^ fps[b]).count("1") <= 2:
            root[find(b)] = find(a)
    out = {}
    for k in range(len(rows)):
        out.setdefault(find(k), []).append(k)
    return list(out.values())


def texts():
    rnd = random.Random(6)
    word = lambda: f"word{rnd.randrange(3000)}"
    out = []
    for _ in range(6):
        base = [word() for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 5, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(200)] = word()
            out.append(" ".join(copy))
    chain = [word() for _ in range(300)]
    for _ in range(20):  # near copies of a near copy
        for _ in range(3):
            chain[rnd.randrange(300)] = word()
        out.append(" ".join(chain))
    return out + ["a b c", "A b C", "x y z w v u"]


@pytest.mark.parametrize("bucket", [64, 3])
def test_stage_against_brute_force(spark, bucket):
    df = docs(spark, *texts())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    expected = sorted((min((rows[k][0] is None, rows[k][0] or 0) for k in g) for g in groups(rows)))
    if bucket == 64:
        out = corpus_pipeline.near_dedup(spark, df, "")
    else:
        from tablediff.llm import minhash

        out = minhash.near_dedup(df, bucket=bucket)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == expected
    assert len(expected) < 30


def test_rows_that_share_a_doc_id_or_have_none(spark):
    rnd = random.Random(7)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(50))
    rows = [(None, text()), (None, text()), (5, text()), (5, text()), (5, text())]
    df = spark.createDataFrame([*rows, rows[0], rows[4]], "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(out, key=str) == sorted(rows, key=str)


def test_signatures_tell_pairs_apart():
    """Pairs of the similarity are never passed over by their minima; most others are."""
    import numpy as np

    from tablediff.llm import minhash

    rnd, by, least = np.random.default_rng(5), minhash.multipliers(42), minhash.fewest_shared(0.8)
    shared = lambda a, b: (np.frombuffer(minhash.signature(minhash.minima(a, by)), "<u2") == np.frombuffer(minhash.signature(minhash.minima(b, by)), "<u2")).sum()
    for n in (10, 90, 450):
        for _ in range(40):
            hashes = rnd.integers(0, 2**64, 2 * n, np.uint64)
            k = n - 2 * n // 18  # k of n + (n - k) are shared: 8/10
            assert shared(hashes[:n], np.concatenate([hashes[:k], hashes[n : 2 * n - k]])) >= least
            assert shared(hashes[:n], hashes[n // 2 :][:n]) < least


def test_equal_hashes_of_other_texts(spark):
    """Texts that share 64 bits of a hash but not 128 are no copies."""
    from tablediff.llm.simhash import one_each

    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id long, text string")
    rows = df.selectExpr("doc_id", "xxhash64(text) AS h", "unhex(md5(text)) AS digest")
    texts = rows.where("doc_id < 3").selectExpr("h", "IF(doc_id = 2, unhex(md5('else')), digest) AS digest", "7L AS root")
    assert sorted(r.doc_id for r in one_each(df, rows, texts).collect()) == [1, 2]


def edited(rnd, copies, edits):
    """Texts of 100 words that are each the same text with edits, which is not among them itself."""
    base = [f"word{rnd.randrange(3000)}" for _ in range(100)]
    out = []
    for _ in range(copies):
        copy = list(base)
        for _ in range(rnd.choice(edits)):
            copy[rnd.randrange(100)] = f"word{rnd.randrange(3000)}"
        out.append(" ".join(copy))
    return out


def rows_made(spark, after):
    """The rows of each Generate and Join of the SQL executions from the given one on, and the number of executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    every = store.executionsList()
    for e in (every.apply(k).executionId() for k in range(every.size())):
        if e >= after:
            values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and ("Generate" in node.name() or "Join" in node.name()) and values.contains(m.accumulatorId()):
                        yield int(values.apply(m.accumulatorId()).replace(",", "")), node.desc()


def test_large_group_of_near_copies(spark):
    """Each text counts for its group once, not once for each band that it shares, and not once for each size."""
    from tablediff.llm import minhash

    rows = list(enumerate(edited(random.Random(8), 200, (1, 2, 3, 4))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList()
    before = max([-1, *(before.apply(k).executionId() for k in range(before.size()))]) + 1
    out = minhash.near_dedup(df, bucket=20).collect()
    assert sorted(r.doc_id for r in out) == sorted(min(g) for g in groups(rows))
    made = list(rows_made(spark, before))
    assert max(made)[0] <= 50 * len(rows), max(made)  # 26 bands a text, and what it has otherwise than most


def test_pairs_of_a_group(spark):
    """Texts that share nothing but the core, parts of it, and other texts: the links connect what brute force does."""
    from tablediff.llm import minhash

    rnd = random.Random(9)
    for size in (5, 12, 40):
        core = [rnd.randrange(2**62) for _ in range(size)]
        sets = [rnd.sample(core, rnd.randint(size // 2, size)) + [rnd.randrange(2**62) for _ in range(rnd.randint(0, size // 4))] for _ in range(40)]
        sets += [rnd.sample(s, max(1, len(s) * 9 // 10)) for s in rnd.sample(sets, 15)] + [[rnd.randrange(2**62) for _ in range(size)]]
        df = spark.createDataFrame([(h, sorted({*s})) for h, s in enumerate(sets)], "h long, hashes array<long>")
        groups_of = spark.createDataFrame([(0, h) for h in range(len(sets))], "key long, h long")
        held = minhash._from_core(groups_of, df, 0.8).cache()
        off = {r.h: r.off for r in held.collect()}
        alike = lambda a, b: 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})
        star = min(off, key=lambda h: (off[h], h))
        linked = [(star, h) for h in off if h != star and alike(star, h)]
        same = {h for q in linked for h in q}
        roots = spark.createDataFrame([(h, min(same)) for h in same] or [(-1, -1)], "node long, root long")
        found = {(r.a, r.b) for r in minhash._apart(held, roots).collect()}
        wanted = {p for p in itertools.combinations(range(len(sets)), 2) if alike(*p) and not {*p} <= same}
        assert wanted and wanted <= found
