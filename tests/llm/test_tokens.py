import os
import random
import zlib

import numpy as np
import pytest

from tablediff.llm import tokens
from tablediff.llm.common import new_folder

from .cases import DOCS_SCHEMA, docs

VOCABULARY = os.environ.get("TOKENIZERS_FOLDER", "/opt/tokenizers") + "/word_bpe_49k.json"


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("by_word", [True, False])
def test_round_trip(spark, encode, by_word):
    df = docs(spark, *[f"Some words {i} and <|endoftext|> more, {'again ' * i}" for i in range(60)])
    folder = new_folder(spark, "tokens")
    files = tokens.write_token_files(df, folder, VOCABULARY, by_word=by_word, docs_per_file=10)
    assert files.count() > 3
    got = sorted(tokens.read_token_files(files).collect(), key=lambda r: r.start)
    rows = [(r.doc_id, encode(r.text)) for r in df.collect()]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    by_id = {}
    for i, ids in rows:
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        assert (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        at += r.n_tokens
    one = files.orderBy("part").first()
    file = tokens.TokenFile(one.path, open(one.dictionary.removeprefix("file://"), "rb").read())
    assert list(file.ids(1)) == dict((i, ids) for i, ids in rows)[int(file.index[1]["doc_id"])]
    with pytest.raises(ValueError):
        tokens.TokenFile(one.path, b"another dictionary")


def test_words_have_the_same_ids_in_any_text(encode, monkeypatch):
    texts = ["It's a test, of 12 pieces\nwith\u00a0LONGER words.\x1cx  e\u0301 \u0301a", "", " <|endoftext|>tied <|startoftext|>", "Ω Σας 😀é", "DOGS' dog's 'S ends. É, x!!'s a.b., (it's) 5!x ÀB-. \\ I'LL'", "<|ENDOFTEXT|>", "<|ENDOFTEXT|> A"]
    rnd = random.Random(12)
    texts += ["".join(rnd.choice("aB1'sS.,!é\u0301 \n<|>-") for _ in range(60)) for _ in range(300)]
    monkeypatch.setattr(tokens, "KEPT", 10)
    got = tokens.Encoder(VOCABULARY, True).encode(texts, 2)
    assert [list(np.frombuffer(g, "<u2")) for g in got] == [encode(t) for t in texts]


def test_empty(spark):
    assert tokens.token_table(spark.createDataFrame([], DOCS_SCHEMA), VOCABULARY).count() == 0
