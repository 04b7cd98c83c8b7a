import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernel.llm import bpe


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def samples():
    rng = random.Random(3)
    out = ["", "x<|endoftext|>y<|endoftext|>", "<|endoftext|>", "<|endoftext", "a" * 3000, "ab" * 2000, " " * 400, "\n\n\n a", "  a  b", "é̀x", "١٢٣٤ ½ Ⅷ", "it's we'll I'VE", "\x00\x01\x1c\x85 ", "\U00010400\U0001e900 𝒳"]
    out += ["".join(rng.choice("abcdeE '  \n\t 　é漢字123!?'st'll") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    out += ["".join(rng.choice(["the", "ing", "th", "e", "in", "g", "a", "aa", "tion", "s", "er"]) for _ in range(30)) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(300)]
    return out


def test_ids_equal_the_library(reference):
    words = bpe.vocabulary(bpe.tokenizer_path())
    for text in samples():
        ids = reference.encode(text, add_special_tokens=False).ids
        encoded = words.encode(text)
        assert np.frombuffer(encoded, np.uint32).tolist() == ids, text[:80]
        assert words.decode(encoded) == reference.decode(ids, skip_special_tokens=False)


def test_query_columns_and_round_trip(make_docs, reference):
    texts = samples()[:40] + [None, "dup", "dup"]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id", None, None)])
    encoded = bpe.encode_texts(docs)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for i, text in enumerate(texts):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        row = rows[i]
        assert (row["n_tokens"], row["ids"]) == (len(ids), ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded).collect()}
    assert back[1] == texts[1] and back[None] == "no id" and back[len(texts) - 3] == ""


def test_piece_table_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    words = bpe.Vocabulary(bpe.tokenizer_path())
    text = " ".join(f"w{i}x" for i in range(200))
    assert words.decode(words.encode(text)) == text and len(words.known) <= 10


def test_empty_table(make_docs):
    assert bpe.encode_texts(make_docs([])).count() == 0
    assert bpe.decode_ids(make_docs([]).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))).count() == 0
