import random

import numpy as np
import pytest

from treeloom.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def ranks(request):
    return byte_bpe.ranks_of(P.path(request.param))


def texts():
    rng = random.Random(0)
    pool = [chr(c) for c in (*range(0, 0x250), 0x3B1, 0x4E2D, 0x6587, 0x1F600, 0x2581, 0xA0, 0x200B, 0xFEFF, 0x0301, 0x10FFFF)]
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    return [*made, "", None, "a" * 20_000, " " * 3000 + "\n\n x", "don't we'll  it's\t\r\n", "<|endoftext|> <unk> ▁x", "中文字" * 500, "the same text", "the same text"]


def test_against_tiktoken(spark, ranks):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = byte_bpe.encode_and_decode(df, ranks, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_encode_then_decode(spark, ranks):
    df = spark.createDataFrame([("hello world",), (None,)], "text string")
    out = byte_bpe.decode(byte_bpe.encode(df, ranks, P.PATTERN), ranks, P.PATTERN).collect()
    assert [bytes(r.decoded) for r in out] == [b"hello world", b""]
    assert byte_bpe.encode(df.limit(0), ranks, P.PATTERN).count() == 0


def test_cache_is_emptied(ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    c = byte_bpe.Codec(byte_bpe.model_of(ranks), P.PATTERN)
    for t in ("a bc d e f g", "x y z", "a bc q"):
        assert c.decode(c.encode(t)) == t.encode()


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        byte_bpe.model_of({b"a": 0, b"b": 2})
