import os
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tablediff.llm import decontaminate, mixing, quality, simhash  # noqa: E402
from tablediff.llm.queries import QUERIES, vocabulary  # noqa: E402

from .test_minhash import groups  # noqa: E402
from .test_mixing import plan  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        out.append((docs, docs := spark.read.parquet(f"{folder}/{k}")))
    return out


def test_stages_against_brute_force(spark, stages):
    rows = lambda df: [(r.doc_id, r.source, r.text) for r in df.collect()]
    for before, after in stages[:-1]:
        assert after.columns == before.columns

    before, after = map(rows, stages[0])
    network = quality.train(stages[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(after) == sorted(r for r in before if network.score((r[2] or "").encode()) >= 0.3)
    assert len(before) * 0.7 < len(after) < len(before)

    before, after = map(rows, stages[1])
    # The stage links five words at a similarity of 0.8, and op1's links besides.
    kept = {min(before[k][0] for k in g) for g in groups([(i, t) for i, _, t in before])}
    assert sorted(after) == sorted(r for r in before if r[0] in kept)

    before, after = map(rows, stages[2])
    items = [" ".join(decontaminate.terms(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(after) == sorted(r for r in before if not any(i in " ".join(decontaminate.terms(r[2])) for i in items))

    before, after = map(rows, stages[3])
    size, target = plan(before)
    taken = Counter()
    for i, s, t in after:
        taken[s] += len(t.split())
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    largest = {s: max(len((t or "").split()) for _, x, t in before if x == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in size)

    before, after = rows(stages[4][0]), stages[4][1].collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {(i, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, _, t in before}
    expected = sorted((i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, _, t in before)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == expected
    order = sorted(after, key=lambda r: r.start)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_every_operator_has_a_query():
    numbers = sorted(int(n.split("_")[0][2:]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert mixing and simhash


@pytest.mark.parametrize("rows", [[], [
    (None, None, "en", "s", 1), (None, "", None, None, 2), (5, "A few words here.", "en", "s", 3), (5, "A few words here.", "en", "s", 3), (6, " \t\n", "de", None, None),
    (7, "Other words of a document that is quite different. " * 40, "en", "t", 4), (7, "Quite another text with the same number, which is not a copy. " * 30, "en", "t", 5),
]])
def test_empty_and_odd_tables(spark, rows):
    """Each stage takes what the one before leaves; nothing crashes, and clean rows stay."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert docs.count() <= 3 * len(rows)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
