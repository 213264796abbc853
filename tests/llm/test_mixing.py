import re
from collections import defaultdict

import pytest

from tablediff.llm import mixing

from .cases import DOCS_SCHEMA, docs


def plan(rows, weights=(5, 2, 1), cap=3):
    """Targets by the rounds themselves: clamp, share the excess again."""
    size = defaultdict(int)
    for _, source, text in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(cap * size[s] for s in clamped)
        target = {s: cap * size[s] if s in clamped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > cap * size[s]}
        if not over:
            return size, target
        clamped |= over


@pytest.mark.parametrize("cut", [True, False])
def test_targets_are_met(spark, cut):
    df = docs(spark, *[f"w{i} " * (i % 37 + 1) for i in range(300)])
    weights = mixing.repeating_weights(df)
    rows = mixing.mix(df, weights, cut=cut).collect()
    size, target = plan([(r.doc_id, r.source, r.text) for r in df.collect()])
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.mix_source_size == size[r.source]
        assert r.mix_target == pytest.approx(target[r.source], rel=1e-12, abs=1e-9)
        assert 0 <= r.mix_taken <= 3 * r.mix_size
        taken[r.source] += r.mix_taken
        largest[r.source] = max(largest[r.source], r.mix_size)
    assert len(rows) == df.count()
    for s in size:
        assert abs(taken[s] - target[s]) <= (0.5001 if cut else largest[s])
    again = mixing.mix(df.repartition(7), weights, cut=cut).collect()
    key = lambda r: str((r.doc_id, r.text, r.mix_taken))
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_repeated_rows(spark):
    df = docs(spark, *[f"w{i} " * (i % 37 + 1) for i in range(300)])
    weights = mixing.repeating_weights(df)
    mixed = mixing.mix(df, weights, cut=False)
    out = mixing.repeated(df, weights=weights)
    assert out.columns == df.columns
    assert out.count() == mixed.agg({"mix_copies": "sum"}).first()[0]


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], DOCS_SCHEMA)
    assert mixing.mix(empty, mixing.repeating_weights(empty)).count() == 0
    blank = docs(spark, None, "", " ", extra=False)
    rows = mixing.mix(blank, mixing.repeating_weights(blank)).collect()
    assert [(r.mix_target, r.mix_taken) for r in rows] == [(0.0, 0)] * 3


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(i, "a" if k % 3 else None, f"w{k} " * (k % 23 + 1)) for k, i in enumerate([7] * 200 + [None] * 200 + list(range(100)))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = mixing.repeating_weights(df)
    found = [sorted(map(str, mixing.mix(df.repartition(n), weights).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "x " * i, i, 2 * i, -1, 5) for i in range(20)], "doc_id long, source string, text string, __s int, __u int, mix_size int, of int")
    weights = mixing.repeating_weights(df)
    out = mixing.mix(df, weights)
    assert out.columns == ["doc_id", "source", "text", "__s", "__u", "of", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    assert all((r["__s"], r["__u"], r["of"], r["mix_size"]) == (r.doc_id, 2 * r.doc_id, 5, r.doc_id) for r in out.collect())
    again = mixing.repeated(df, weights=weights)
    assert again.columns == df.columns and {r.mix_size for r in again.collect()} == {-1}
