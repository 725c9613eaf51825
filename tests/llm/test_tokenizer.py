import os
import random

import pytest

from slipweave.llm import tokenizer
from slipweave.llm.tokenizer import VOCABULARY, decode_stream, open_bytes, transducer

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is absent")
ALPHABET = "aAbeéöก็น้ำのを漢字 ²½①Ⅳ_'s 12๓\n\t\x1c 　.-😀​"


def texts():
    r = random.Random(5)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(90))) for _ in range(400)]
    out += ["".join(r.choice("0123456789") for _ in range(r.randrange(1, 20))) for _ in range(300)]
    return out + ["", " ", "\n\n  x", "it's we'll", "a" * 9000, "ab" * 5000, " " * 5000, "ไม่มีช่องว่าง" * 600, "<|endoftext|>", "漢" * 5000]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    t = transducer()
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert t.encode(text) == want.ids, text[:80]
        assert t.decode(want.ids) == text


def test_tokens_are_emitted_before_the_end():
    pieces = list(transducer().tokens(("ไม่มีช่องว่าง" * 2000).encode()))
    assert len(pieces) > 10 and all(pieces)


def test_streaming_decoder():
    t = transducer()
    ids = t.encode("漢字😀 ก็")
    seen = list(decode_stream(t.by_id, ids))
    assert "".join(seen) == "漢字😀 ก็" and all("�" not in s for s in seen)
    assert [open_bytes(b) for b in (b"a", "é".encode()[:1], "漢".encode()[:2], "😀".encode()[:3], "😀".encode(), b"")] == [0, 1, 2, 3, 0, 0]


def test_tables(spark):
    rows = [(1, "hello world", "i"), (2, None, "i"), (3, "", "i"), (3, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _x string")
    out = tokenizer.encode(df).collect()
    assert sorted((r.doc_id, list(r.ids), r._x) for r in out) == [(1, transducer().encode("hello world"), "i"), (2, [], "i"), (3, [], "i"), (3, [], "i")]
    assert sorted(tuple(r) for r in tokenizer.count_tokens(df).select("doc_id", "n_tokens").collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert sorted((r.doc_id, r.text) for r in tokenizer.decode(tokenizer.encode(df)).collect()) == [(1, "hello world"), (2, ""), (3, ""), (3, "")]
    assert tokenizer.encode(df.limit(0)).count() == 0
