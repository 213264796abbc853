import random

import pytest

from tablediff.llm.decontaminate import Index, Shard, contaminated, decontaminated, shards, terms

from .cases import DOCS_SCHEMA, docs

ITEMS = "item_id long, text string, n long"


def words(rnd, n):
    return [rnd.choice(["the", "of", "and", f"w{rnd.randrange(80)}", f"rare{rnd.randrange(3000)}"]) for _ in range(n)]


def items(rnd, n=60):
    return [(i, " ".join(words(rnd, rnd.randrange(12, 30))) + ". " + " ".join(words(rnd, rnd.randrange(5, 12))) + ".") for i in range(n)]


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.6])
def test_search_against_all_scores(threshold):
    rnd = random.Random(8)
    index = Index(items(rnd))
    for _ in range(60):
        query = index.docs.keys() & set(words(rnd, rnd.randrange(1, 120)))
        every = {}
        for w in query:
            for k, x in zip(index.docs[w], index.weights[w]):
                every[k] = every.get(k, 0) + x
        assert dict(index.above(query, threshold)) == pytest.approx({k: x for k, x in every.items() if x >= threshold})
    for k, item in enumerate(items(random.Random(8))):
        assert dict(index.above(set(terms(item[1])), 0.99))[k] == pytest.approx(1)


@pytest.mark.parametrize("threshold", [0.1, 0.3])
def test_blocks_in_blocks_are_passed_over(threshold, monkeypatch):
    from tablediff.llm import decontaminate

    monkeypatch.setattr(decontaminate, "FAN", 3)
    rnd = random.Random(12)
    index, searched = Index(items(rnd, 400)), []
    assert len(index.levels) > 3
    inside, search = index._inside, index._search
    index._inside = lambda block, level, query: searched.append(level) or inside(block, level, query)
    index._search = lambda block, query, threshold: searched.append(-1) or search(block, query, threshold)
    for _ in range(40):
        query = index.docs.keys() & set(words(rnd, rnd.randrange(1, 60)))
        every = {}
        for w in query:
            for k, x in zip(index.docs[w], index.weights[w]):
                every[k] = every.get(k, 0) + x
        assert dict(index.above(query, threshold)) == pytest.approx({k: x for k, x in every.items() if x >= threshold})
    assert searched.count(-1) < 40 * 100 * (0.9 if threshold < 0.2 else 0.3)  # of 100 blocks for each query


def test_shards_score_alike(spark):
    rnd = random.Random(13)
    known = items(rnd, 80)
    texts = [" ".join(words(rnd, 60)) + " " + known[rnd.randrange(80)][1][rnd.randrange(40) :] for _ in range(150)]
    df, bench = docs(spark, *texts), spark.createDataFrame([(*r, 1) for r in known], ITEMS)
    alone = [Shard(known)]
    several = list(shards(bench, shard_bytes=2000))
    assert len(several) > 3
    for r in df.collect():
        found = [
            {i: tuple(round(v, 9) for v in values) for x in some for i, *values in x.found(r.text, 0.4, 0.3)} for some in (alone, several)
        ]
        assert found[0] == found[1]


def test_planted_items(spark):
    rnd = random.Random(9)
    known = items(rnd)
    texts = [" ".join(words(rnd, rnd.randrange(5, 400))) for _ in range(60)]
    planted = set()
    for i in range(0, 60, 2):
        k, at = rnd.randrange(len(known)), rnd.randrange(len(texts[i]))
        at = texts[i].find(" ", at)
        texts[i] = f"{texts[i][:at]} {known[k][1].upper() if i % 4 else known[k][1]} {texts[i][at:]}"
        planted.add((i, k))
    df = docs(spark, *texts)
    bench = spark.createDataFrame([(*r, 1) for r in known] + [(70, None, 1), (71, "?!", 1), (72, "", 1), (None, "item without an id of its own.", 1)], ITEMS)
    got = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= planted
    assert all((r.doc_id, r.item_id) in planted for r in got)
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == df.count() - len({i for i, _ in planted})
    assert sum(len(x.items) for s in shards(bench, shard_bytes=300) for x in s.indexes) == len(known) + 1
    several = contaminated(df, bench, shard_bytes=2000)
    assert sorted(map(tuple, several.collect())) == sorted(map(tuple, got))
    assert "MapInArrow" not in several._jdf.queryExecution().toString()  # written, one shard after the other
    left = decontaminated(df, bench, shard_bytes=2000)
    assert left.columns == df.columns and sorted(map(str, left.collect())) == sorted(map(str, kept.collect()))
    assert "MapInArrow" not in left._jdf.queryExecution().toString()


def test_a_long_item_changes_nothing_for_others(spark):
    """Words that stand far apart hold no short item, however long another item is."""
    rnd = random.Random(21)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa. The answer is lambda mu nu."
    filler = lambda n: [f"f{rnd.randrange(10**6)}" for _ in range(n)]
    spread = " ".join(w for three in ("alpha beta gamma delta epsilon", "zeta eta theta iota kappa", "The answer is lambda mu nu") for w in [three, *filler(300)])
    other = " ".join(f"o{k}" for k in range(5000)) + ". It is so."
    df = docs(spark, spread, f"{' '.join(filler(200))} {item} {' '.join(filler(200))}", f"before {other} after", extra=False)
    for known, expected in (([(1, item)], {(1, 1)}), ([(1, item), (2, other)], {(1, 1), (2, 2)})):
        bench = spark.createDataFrame(known, "item_id long, text string")
        got = contaminated(df, bench, threshold=0.3, overlap=0.3).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected
    lengths = [(n, " ".join(f"x{n}y{k}" for k in range(n)) + ".") for n in (1, 2, 63, 64, 65, 255, 256, 257, 1025, 4000)]
    texts = docs(spark, *[" ".join([*filler(rnd.randrange(500)), t, *filler(50)]) for _, t in lengths], extra=False)
    got = contaminated(texts, spark.createDataFrame(lengths, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(k, n) for k, (n, _) in enumerate(lengths)}


def test_empty(spark):
    df, none = docs(spark, "some text"), spark.createDataFrame([], ITEMS)
    assert contaminated(df, none).count() == 0
    assert decontaminated(df, none).count() == df.count()
    empty = spark.createDataFrame([], DOCS_SCHEMA)
    assert contaminated(empty, spark.createDataFrame([(1, "an item.", 1)], ITEMS)).count() == 0
