import itertools
import random
import re

import pytest
import xxhash

from tablediff.llm.simhash import simhash_dedup, simhash_groups

from .cases import DOCS_SCHEMA, docs


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = [fingerprint(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return [(i, f"{fps[k]:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def texts():
    rnd = random.Random(3)
    base = [f"word{rnd.randrange(500)}" for _ in range(400)]
    out = [" ".join(base)] * 3
    for k in range(40):  # near copies of a near copy
        base = list(base)
        base[rnd.randrange(400)] = f"other{k}"
        out.append(" ".join(base))
    return out + ["A b C d", "a B c D", "two words", "TWO words"]


@pytest.mark.parametrize("bucket", [64, 2])
def test_against_brute_force(spark, bucket):
    df = docs(spark, *texts())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r)[:3] for r in simhash_groups(df, bucket=bucket).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(components(rows), key=key)


def test_one_of_each_group_stays(spark):
    df = docs(spark, *texts())
    rows = components([(r.doc_id, r.text) for r in df.collect()])
    kept = simhash_dedup(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in rows if i == c}
    assert kept.count() == len({i for i, _, c in rows if i == c})


def test_rows_of_other_groups_stay(spark):
    rnd = random.Random(9)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(50))
    rows = [(None, text()), (None, text()), (5, text()), (5, text())]
    df = spark.createDataFrame([*rows, rows[0], rows[3]], "doc_id long, text string")
    assert sorted(map(tuple, simhash_dedup(df).collect()), key=str) == sorted(rows, key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS_SCHEMA)
    assert simhash_groups(empty).count() == 0
    assert simhash_dedup(empty).count() == 0
