"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file holds, in this order (all numbers little-endian):

    8 bytes   magic
    32 bytes  SHA-256 of the dictionary
    4 bytes   bytes of one id (2 or 4)
    frames    one zstandard frame for each document
    index     one INDEX record for each document: where its frame is
    24 bytes  offset of the index, number of documents, magic

A document is read with the last 24 bytes, its index record and its frame.
The dictionary lies beside the files, as does a table of the files.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder
from .files import Replaced, filesystem

MAGIC = b"TDTOKEN1"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
TAIL = struct.Struct("<QQ8s")
HEAD = len(MAGIC) + 32 + 4
#: Files of a range, about; a task puts so many into order.
FILES = 64
#: Stands for a null doc_id, as the least of all.
NO_ID = -(2**63)
#: ASCII marks, which may follow a letter or digit at the end of a word.
MARKS = string.punctuation.encode()
#: Words whose ids a worker keeps; beyond that only those of the texts at hand.
KEPT = 300_000
#: What a tokenizer must do for a word to have the same ids in any text.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
}
WORD_END = "</w>"
_encoders: dict[tuple[str, bool], Encoder] = {}


def by_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space, never joins what it parts, and parts letters and digits from marks."""
    model, has = tokenizer.model, lambda part: json.loads(part.__getstate__()) if part else {}
    split, *rest = has(tokenizer.pre_tokenizer).get("pretokenizers", [None])
    return (
        has(tokenizer.normalizer) == NORMALIZER
        and split == SPLIT
        and [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in rest] == [("ByteLevel", False, False)]
        and type(model).__name__ == "BPE"
        and (model.dropout, model.end_of_word_suffix) == (None, WORD_END)
        and all(t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word) for t in tokenizer.get_added_tokens_decoder().values())
    )


class Encoder:
    """A tokenizer of the tokenizers library, kept by each worker with the ids of words that it has met.

    With `by_word`, and if the tokenizer's file allows it (by_words), a word has
    the same ids wherever it stands, in capitals or not, and with or without
    marks after it, so each is encoded once. Else whole texts are encoded.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])  # for small ASCII letters, which nothing changes or parts
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.by_word = by_word and by_words(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.last = np.zeros(size, bool)
        for token, k in vocabulary.items():
            self.last[k] = token.endswith(WORD_END)

    @classmethod
    def of(cls, path: str, by_word: bool) -> Encoder:
        if (path, by_word) not in _encoders:
            _encoders[path, by_word] = cls(path, by_word)
        return _encoders[path, by_word]

    def encode(self, texts: pa.Array | list[str], end: int) -> list[bytes]:
        """The ids of each text and `end`, as bytes of `dtype`."""
        last, texts = np.array([end], self.dtype).tobytes(), pa.array(texts, pa.string())
        if not self.by_word:
            return [i + last for i in self._ids(texts.to_pylist())]
        words, which, counts = _words(texts)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {w: self.known[w] for w in words if w in self.known}
        self._learn(set(new))
        ids = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        sizes, starts = sizes[which], starts[which]
        stops = np.cumsum(sizes)
        at = np.repeat(starts - (stops - sizes), sizes)
        at += np.arange(len(at))
        out = np.frombuffer(b"".join(ids), self.dtype)[at].tobytes()
        stops = (np.concatenate([[0], stops])[np.cumsum(counts)] * self.dtype.itemsize).tolist()
        return [out[a:b] + last for a, b in zip([0, *stops], stops)]

    def _learn(self, words: set[bytes]) -> None:
        """Gets the ids of new words; marks at their ends have ids of their own."""
        known, plain, letters, rest, cut = self.known, [], [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # ASCII
                plain.append(w)
            elif b"<|" not in w and w[-1:] in MARKS and (core := w.rstrip(MARKS))[-1:].isalnum():
                cut.append((w, core, w[len(core) :]))
            else:
                (letters if w.decode().isalpha() else rest).append(w)
        for p in {p for _, *pair in cut for p in pair}:
            if p not in known and p not in words:
                (plain if p.isalpha() and p.islower() else letters if p.decode().isalpha() else rest).append(p)
        for some, tokenizer in ((plain, self.plain), (letters, self.tokenizer)):
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                ids = self._ids([b" ".join(part).decode()], tokenizer)[0]
                stops = ((np.flatnonzero(self.last[np.frombuffer(ids, self.dtype)]) + 1) * self.dtype.itemsize).tolist()
                if len(stops) == len(part):
                    known.update(zip(part, map(ids.__getitem__, map(slice, [0, *stops], stops))))
                else:  # some are more than one word to the tokenizer
                    rest += part
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            known.update(zip(part, self._ids([w.decode() for w in part])))
        known.update((w, known[a] + known[b]) for w, a, b in cut)

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts, which of them follow each other, and how many each text has.

    In lower case, but as they are where the text may hold a special token.
    """
    lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()


def train_dictionary(
    docs: DataFrame, n_docs: int, encoder: tuple[str, bool], end: int, sample: int = 1000, sample_bytes: int = 4096, size: int = 65536
) -> bytes:
    """A zstandard dictionary from the id arrays of `sample` of the `n_docs` documents, or of all if they are fewer.

    They are those with the least hash of doc_id and text. Each gives
    `sample_bytes` from a place that its hash chooses, anywhere in it. Too few
    documents give an empty dictionary.
    """
    place = F.xxhash64("doc_id", "text").alias("place")
    near = F.pmod(F.col("place"), F.lit(max(1, n_docs // (4 * sample)))) == 0  # four times as many, to sort less
    picked = docs.select("text", place).where(near).orderBy("place").limit(sample)

    def run(batches):
        for batch in batches:
            ids = Encoder.of(*encoder).encode(batch.column(0).fill_null(""), end)
            starts = [place % max(1, len(i) - sample_bytes) // 4 * 4 for i, place in zip(ids, batch.column(1).to_pylist())]
            found = [i[at : at + sample_bytes] for i, at in zip(ids, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    samples = sorted(bytes(r["ids"]) for r in picked.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def ranges(keys: DataFrame, parts: int) -> list[tuple]:
    """Where the ranges of `keys` begin, but for the first: at most `parts` ranges of about as many rows."""
    order = [F.col(c).asc_nulls_first() for c in keys.columns]
    least = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys.columns)).alias("least"))
    return sorted(tuple(r["least"]) for r in least.select("least").collect())[1:]  # one row for each range


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 2, by_word: bool = False, docs_per_file: int = 4096, level: int = 3
) -> DataFrame:
    """Encodes `docs` (doc_id, text; other columns are ignored) and writes token files to `folder`.

    Documents are in ascending order of doc_id, nulls first, in each file and
    from file to file; of rows with the same doc_id the order is by the hash of
    the text. Null texts are as empty ones: only the end id. An empty table
    gives no file. Texts are compressed before the one shuffle, by ranges of
    doc_id and hash, each of at most FILES files about and one task; so rows
    that share or lack a doc_id have as many ranges as any others. Returns the
    table of files (part, path, dictionary, n_docs, n_tokens), also written to
    `folder`/files. A retried task writes the same files anew and renames them.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    n_docs = keyed.count()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-n_docs // docs_per_file), max(width, -(-n_docs // (FILES * docs_per_file)))))
    cuts = ranges(keyed.select("doc_id", "h"), parts) if parts > 1 else []
    dictionary = train_dictionary(keyed, n_docs, (tokenizer, by_word), end)
    digest = hashlib.sha256(dictionary).digest()
    dictionary_path = f"{folder}/dictionary-{digest.hex()}"
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary-{digest.hex()}") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast((dictionary, cuts))

    def encode(batches):
        dictionary, cuts = shared.value
        encoder = Encoder.of(tokenizer, by_word)
        compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary)).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, hashes, texts = (c.slice(at, 1024) for c in batch.columns)
                arrays, width = encoder.encode(texts.fill_null(""), end), encoder.dtype.itemsize
                frames = [width.to_bytes(1, "little") + compress(a) for a in arrays]
                counts = [len(a) // width for a in arrays]
                part = [bisect_right(cuts, key) for key in zip(ids.to_pylist(), hashes.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), ids, hashes, pa.array(frames, pa.binary()), pa.array(counts, pa.int64())],
                    ["part", "doc_id", "h", "frame", "n_tokens"],
                )

    def write(batches):
        out = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("part", "doc_id", "frame", "n_tokens")]
            for part, doc_id, frame, n in zip(*columns):
                if out is None or out.range != part or len(out.rows) >= docs_per_file:
                    if out:
                        yield out.close()
                    out = _Writer(folder, part, out.place + 1 if out and out.range == part else 0, digest, frame[0])
                out.add(None if doc_id == NO_ID else doc_id, frame[1:], n)
        if out:
            yield out.close()

    frames = keyed.mapInArrow(encode, "part int, doc_id long, h long, frame binary, n_tokens long")
    files = (
        frames.repartitionById(parts, "part")  # each range in a task of its own
        .sortWithinPartitions("part", "doc_id", "h", "frame")
        .mapInArrow(write, "part long, path string, n_docs long, n_tokens long")
    )
    files = files.withColumn("dictionary", F.lit(dictionary_path))
    files.write.parquet(f"{folder}/files")
    return spark.read.schema(files.schema).parquet(f"{folder}/files")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class _Writer:
    """The file at `place` among those of a range."""

    def __init__(self, folder: str, part: int, place: int, digest: bytes, width: int):
        self.range, self.place, self.uri = part, place, f"{folder}/tokens-{part:08d}-{place:06d}.bin"
        self.out = Replaced(self.uri)
        self.out.write(MAGIC + digest + struct.pack("<I", width))
        self.at, self.rows = HEAD, []

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), n))
        self.at += len(frame)

    def close(self) -> pa.RecordBatch:
        index = np.array(self.rows, dtype=INDEX)
        self.out.write(index.tobytes() + TAIL.pack(self.at, len(index), MAGIC))
        self.out.close()
        columns = [
            pa.array([self.range << 32 | self.place], pa.int64()), pa.array([self.uri]), pa.array([len(index)], pa.int64()),
            pa.array([int(index["n_tokens"].astype("i8").sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "path", "n_docs", "n_tokens"])


class TokenFile:
    """Reads one file: `index`, and any document by its place in it."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        offset, n, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        head = self.file.read_at(HEAD, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        if head[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.dtype = np.dtype(f"<u{struct.unpack('<I', head[-4:])[0]}")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, offset), dtype=INDEX)
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, place: int) -> np.ndarray:
        row = self.index[place]
        return np.frombuffer(self.decompress(self.file.read_at(int(row["length"]), int(row["offset"]))), dtype=self.dtype)


def read_token_files(files: DataFrame) -> DataFrame:
    """What the files of `files` (as write_token_files returns) hold, one row for each document.

    doc_id, start (ids of all documents before it, in all files), n_tokens and
    ids_crc32, the CRC-32 of its ids as little-endian unsigned 32-bit integers.
    Only the counts of the files, a row for each, are summed in one task.
    """
    from pyspark.sql import Window

    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    placed = files.select("path", "dictionary", "n_docs", F.coalesce(before, F.lit(0)).alias("before"))
    n = max(1, files.count())

    def run(batches):
        for batch in batches:
            for path, dictionary, before in zip(*(batch.column(k).to_pylist() for k in ("path", "dictionary", "before"))):
                fs, where = filesystem(dictionary)
                with fs.open_input_stream(where) as f:
                    file = TokenFile(path, f.read())
                start, step = before, 1024
                for at in range(0, len(file.index), step):
                    rows = file.index[at : at + step]
                    counts = rows["n_tokens"].astype(np.int64)
                    crcs = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(at, at + len(rows))]
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    ids = pa.array(rows["doc_id"], mask=rows["has_id"] == 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end: int = 2, by_word: bool = False) -> DataFrame:
    """Writes `docs` (doc_id, text) as token files in a new folder beside the checkpoints, and reads them back.

    Null, empty and repeated rows each give a row (see write_token_files); an empty table gives none.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end, by_word))
