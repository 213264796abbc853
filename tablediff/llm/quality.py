"""A quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided, sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of a chunk, and between the starts of two: chunks overlap and cover the whole text.
CHUNK, HOP = 512, 448
#: Bytes that a filter sees, and between two places of it.
WIDTH, STEP = 8, 4
PLACES = (CHUNK - WIDTH) // STEP + 1


@dataclass
class Network:
    """Bytes are embedded, `filters` slide over each chunk, and their outputs are max-pooled.

    A linear layer makes a logit of each chunk; the mean over all chunks of a
    text is the text's logit.
    """

    embedding: np.ndarray  # 256, size
    filters: np.ndarray  # WIDTH * size, filters
    bias: np.ndarray
    largest: np.ndarray  # weights of the max-pooled outputs
    offset: np.ndarray  # one number

    @classmethod
    def new(cls, rng: np.random.Generator, size: int = 6, filters: int = 32) -> Network:
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        return cls(
            normal(256, size) * 0.5, normal(WIDTH * size, filters) / np.float32(np.sqrt(WIDTH * size)), np.zeros(filters, np.float32),
            normal(filters) * 0.1, np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.largest, self.offset]

    def outputs(self, chunks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """For chunks (n, CHUNK) of bytes: the filters' inputs, and their outputs at each place, 0 where there is no text."""
        n, size = len(chunks), self.embedding.shape[1]
        bytes_ = self.embedding[chunks]
        s = bytes_.strides
        seen = as_strided(bytes_, (n, PLACES, WIDTH * size), (s[0], STEP * s[1], s[2])).reshape(n * PLACES, -1)
        z = seen @ self.filters
        z += self.bias
        out = np.maximum(z, 0, out=z).reshape(n, PLACES, -1)
        counts = np.clip((sizes - WIDTH) // STEP + 1, 1, PLACES)
        inside = np.arange(PLACES) < counts[:, None]
        out *= inside[:, :, None]
        return seen, out

    def logits(self, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        _, out = self.outputs(chunks, sizes)
        return out.max(axis=1) @ self.largest + self.offset

    def score(self, text: bytes, piece: int = 256) -> float:
        """The probability of label 1, from the whole text, `piece` chunks at a time."""
        total, n = 0.0, n_chunks(len(text))
        for at in range(0, n, piece):
            total += float(self.logits(*cut(text, np.arange(at, min(n, at + piece)))).sum())
        return float(1 / (1 + np.exp(-np.clip(total / n, -60, 60))))


def n_chunks(n_bytes: int) -> int:
    return max(1, -(-(n_bytes - (CHUNK - HOP)) // HOP))


def cut(text: bytes, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of a text, padded with zeros, and how many bytes each has."""
    starts = which * HOP
    out = np.zeros((len(which), CHUNK), np.uint8)
    for row, a in zip(out, starts):
        part = np.frombuffer(text[a : a + CHUNK], np.uint8)
        row[: len(part)] = part
    return out, np.minimum(len(text) - starts, CHUNK)


def draw(text: bytes, chunks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `chunks` chunks of a text and their sizes, drawn from all of it."""
    n = n_chunks(len(text))
    rng = np.random.default_rng(seed)
    return cut(text, np.arange(n) if n <= chunks else np.sort(rng.choice(n, chunks, replace=False)))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7, steps: int = 900, chunks: int = 6, batch: int = 64, rate: float = 0.01) -> Network:
    """Trains on (chunks of a text, their sizes, label 0 or 1) by Adam on the log loss, for `steps` batches, about, in whole epochs.

    An epoch sees up to `chunks` chunks of each text, drawn anew. Without both
    labels the result is a constant, the share of label 1 (1 without samples).
    """
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    labels = np.array([y for *_, y in samples], np.float32)
    if len(set(labels.tolist())) < 2:
        net.largest[:] = 0
        net.offset[:] = 8 if not len(labels) or labels[0] else -8
        return net
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    batches = -(-len(samples) // batch)
    epochs = -(-steps // batches)
    step, total = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            rows, data, sizes = order[at : at + batch], [], []
            for r in rows:
                part, size, _ = samples[r]
                some = slice(None) if len(part) <= chunks else np.sort(rng.choice(len(part), chunks, replace=False))
                data.append(part[some])
                sizes.append(size[some])
            owner = np.repeat(np.arange(len(rows)), [len(d) for d in data])
            gradients = _gradients(net, np.concatenate(data), np.concatenate(sizes), owner, labels[rows])
            step += 1
            lr = rate * (1 - step / total) + rate / 50
            for p, g, (m, v) in zip(net.parts(), gradients, state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, chunks: np.ndarray, sizes: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    seen, out = net.outputs(chunks, sizes)
    n, _, filters = out.shape
    top, largest = out.argmax(axis=1), out.max(axis=1)
    per = np.bincount(owner, minlength=len(labels))
    logit = np.bincount(owner, largest @ net.largest + net.offset, len(labels)) / per
    d = ((1 / (1 + np.exp(-logit)) - labels) / len(labels) / per)[owner].astype(np.float32)
    dz = np.zeros_like(out)
    dz[np.arange(n)[:, None], top, np.arange(filters)] = d[:, None] * net.largest
    dz *= out > 0
    dz = dz.reshape(-1, filters).astype(net.filters.dtype)
    d_filters = seen.T @ dz
    d_seen = (dz @ net.filters.T).reshape(-1, WIDTH, net.embedding.shape[1])
    at = sliding_window_view(chunks, WIDTH, axis=1)[:, ::STEP].reshape(-1)
    d_embedding = np.stack([np.bincount(at, d_seen[:, :, k].reshape(-1), 256) for k in range(net.embedding.shape[1])], axis=1)
    return [d_embedding, d_filters, dz.sum(axis=0), d @ largest, np.array([d.sum()])]


def held_out() -> F.Column:
    """True for the fifth of all doc_id by CRC-32 from which no label is learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, chunks: int = 16, seed: int = 7) -> Network:
    """Fits a network on `sample` labelled documents, or on all if they are fewer: those with the least hash of doc_id.

    Of each whole text `chunks` chunks are drawn, so the driver gets at most
    sample * chunks * CHUNK bytes. Rows that are held out, or whose doc_id or
    quality is null, are never used. Of several labels of a doc_id the least
    counts, and of several texts the one with the least hash. Without labels
    the network takes all texts for good.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    known = known.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    rows = known.join(texts, F.col("id") == F.col("doc")).select("id", F.xxhash64("text").alias("h"), "quality", "text")

    def cut_all(batches):
        for batch in slices(batches, 64):
            ids, hs, labels, texts = batch.columns
            parts = [draw(t or b"", chunks, (seed, i % 2**63)) for t, i in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist())]
            data, sizes = [p.tobytes() for p, _ in parts], [n.tolist() for _, n in parts]
            yield pa.RecordBatch.from_arrays([ids, hs, labels.cast(pa.int64()), pa.array(data, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))], ["id", "h", "label", "data", "sizes"])

    drawn = rows.mapInArrow(cut_all, "id long, h long, label long, data binary, sizes array<long>")
    drawn = drawn.groupBy("id").agg(F.min_by(F.struct("label", "data", "sizes"), "h").alias("one")).select("id", "one.*")
    found = sorted((r["id"], r["label"], bytes(r["data"]), r["sizes"]) for r in drawn.collect())
    return fit([(np.frombuffer(d, np.uint8).reshape(-1, CHUNK), np.array(n), y) for _, y, d, n in found], seed)


def scored(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """Scores every row of `docs` (doc_id, text; other columns are ignored) by its whole text.

    Returns doc_id, held_out, score and predicted. Null texts score as empty ones.
    Rows count for themselves, so repeated ones, and any doc_id, give a row each.
    """

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            scores = pa.array([network.score(t or b"") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` (text; all columns are kept) that score at `threshold` or above.

    Null texts score as empty ones; repeated rows stay or go together; an empty table gives an empty one.
    """

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([network.score(t or b"") >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
