import random
import zlib

import numpy as np
import pytest

from tablediff.llm import quality

from .cases import DOCS_SCHEMA, docs


def corpus(n=400):
    rnd = random.Random(6)
    words = ["".join(rnd.choice(["ba", "no", "ti", "er", "the", "un"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        good = " ".join(rnd.choice(words) for _ in range(rnd.randrange(20, 300)))
        bad = [good.upper().replace(" ", "!! "), (rnd.choice(words) + " ") * 80, " | ".join(good.split())][i % 3]
        out.append((good, 1) if i % 4 else (bad, 0))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    df = docs(spark, *[t for t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    network = quality.train(df, labels)
    got = quality.scored(df, network).collect()
    assert len(got) == df.count()
    right = []
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id < len(rows):
            right.append(r.predicted == rows[r.doc_id][1])
    assert np.mean(right) > 0.95
    kept = quality.accepted(df, network)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_whole_texts_count():
    rng = np.random.default_rng(1)
    net = quality.Network.new(rng)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        text = rng.integers(97, 123, n, dtype=np.uint8).tobytes()
        assert net.score(text, piece=3) == pytest.approx(net.score(text), abs=1e-6)
        covered = {b for c in range(quality.n_chunks(n)) for b in range(c * quality.HOP, c * quality.HOP + quality.CHUNK)}
        assert set(range(n)) <= covered
    long = b"good words here " * 400
    assert net.score(long + b"###!!! " * 400) != net.score(long)


def test_gradients():
    rng = np.random.default_rng(2)
    net = quality.Network.new(rng)
    for p, q in zip(net.parts(), [f"{n}" for n in net.__dataclass_fields__]):
        setattr(net, q, p.astype(np.float64))
    parts = [quality.cut(rng.integers(97, 105, n, dtype=np.uint8).tobytes(), np.arange(quality.n_chunks(n))) for n in (100, 900)]
    chunks, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner, labels = np.array([0, 1, 1]), np.array([1.0, 0.0])

    def loss():
        logit = np.bincount(owner, net.logits(chunks, sizes)) / np.bincount(owner)
        return np.mean(np.logaddexp(0, logit) - labels * logit)

    for p, g in zip(net.parts(), quality._gradients(net, chunks, sizes, owner, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-5
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        assert (up - loss()) / (2 * eps) == pytest.approx(g[at], rel=2e-2)
        p[at] = old


def test_no_labels(spark):
    empty = spark.createDataFrame([], DOCS_SCHEMA)
    network = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.scored(empty, network).count() == 0
    assert network.score(b"anything") > 0.9
