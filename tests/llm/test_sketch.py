import hashlib
import random

from pyspark.sql import functions as F

from tablediff.llm import sketch

from .cases import DOCS_SCHEMA, docs


def test_edits_and_estimates(spark):
    rnd = random.Random(1)
    texts = [" ".join(f"t{rnd.randrange(10**6)}é" for _ in range(rnd.randrange(1, 800))) for _ in range(60)]
    df = docs(spark, *texts, texts[5])
    rows = {}
    for r in df.collect():
        rows.setdefault(r.doc_id, []).append(r.text or "")
    order = sorted(rows, key=lambda i: (i is not None, i or 0), reverse=True)
    got = sketch.fingerprints_with_edits(df).collect()
    assert len(got) == df.count()
    by_print = {}
    for r in got:
        following = min(rows[order[(order.index(r.doc_id) + 1) % len(order)]])
        edited = []
        for t in rows[r.doc_id]:
            k = len(t) // 3
            edited.append(hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest())
        assert r.edited_sha256 in edited
        assert r.n_chars in [len(t) for t in rows[r.doc_id]]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_print[r.doc_id] = r
        if r.n_chars > 3000 and r.doc_id is not None and r.doc_id < 100:
            assert 0.25 < r.near_edited < 0.75
            assert r.near_next < 0.1
    assert by_print[5].fingerprint == by_print[60].fingerprint
    for i in (901, 902):  # without words: equal fingerprints
        assert by_print[i].near_next == by_print[i].near_edited == 1.0
    assert by_print[901].fingerprint == by_print[900].fingerprint == ""


def jaccard(a, b):
    sets = []
    for t in (a, b):
        words = t.split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_likeness_against_brute_force(spark):
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(3000)]
    texts = []
    for n in (1, 3, 5, 8, 20, 60, 70, 200, 700, 3000):
        for edits in (0, 1, 3, n // 10, n // 2):
            words = base[:n]
            for _ in range(edits):
                words[rnd.randrange(n)] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", " "]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    x, y = (sketch.sketch(F.col(c)) for c in "ab")
    rows = df.select("a", "b", sketch.likeness(x, y).alias("j"), sketch.containment(sketch.merged(x, y), y).alias("c"), (x == y).alias("same")).collect()
    for r in rows:
        n = max(len(t.split()) for t in (r.a, r.b))
        assert abs(r.j - jaccard(r.a, r.b)) <= (1e-12 if n <= 67 else 0.22), (r.a[:50], r.b[:50], r.j)
        assert r.same == (r.a.split() == r.b.split() or jaccard(r.a, r.b) == 1 or n > 67 and r.j == 1)
        assert r.c is None or 0 <= r.c <= 1


def test_exact_without_threshold(spark):
    a, b = "a b c d e f g h", "a b c d e f x y z"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    s = [sketch.sketch(F.col(c), fraction=0.999999) for c in "ab"]
    row = df.select(sketch.likeness(*s).alias("j"), sketch.containment(*s).alias("c"), F.size(sketch.merged(*s)).alias("n")).first()
    assert (row.j, row.c, row.n) == (2 / 7, 2 / 4, 7)


def test_one_and_none(spark):
    assert sketch.fingerprints_with_edits(spark.createDataFrame([], DOCS_SCHEMA)).count() == 0
    one = sketch.fingerprints_with_edits(docs(spark, "abc def", extra=False)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
