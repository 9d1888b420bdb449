import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamroute.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def mine():
    return bpe.speculator()


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(mine, theirs, text):
    assert mine.encode(text) == theirs(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinorst EINORST019 _-=\n\t'é日😀", max_size=80))
def test_texts_near_words(mine, theirs, text):
    assert mine.encode(text) == theirs(text)


def test_every_pair_verdict_is_exact(mine):
    """The seam test against exact merging of the joined bytes."""
    import numpy as np

    r = random.Random(7)
    ids = sorted(mine.bytes_of)
    a = np.array([r.choice(ids) for _ in range(4000)] + [r.randrange(1500) for _ in range(4000)])
    b = np.array([r.choice(ids) for _ in range(4000)] + [r.randrange(1500) for _ in range(4000)])
    ok = mine.compatible(a, b)
    want = [mine.exact(mine.bytes_of[int(x)] + mine.bytes_of[int(y)]) == [int(x), int(y)] for x, y in zip(a, b)]
    assert ok.tolist() == want and any(want) and not all(want)


def test_special_strings_runs_and_repeats(mine, theirs):
    for t in ("<|endoftext|>", " " * 500, "\r\n\r\n \n", "a" * 3000, "ab" * 999, "=" * 777, "'s's 'll", "​́", "0" * 100):
        assert mine.encode(t) == theirs(t)


def test_tables_with_nulls_empty_and_long_texts(spark, mine, theirs, monkeypatch):
    long = " ".join(f"word{i} {i}" for i in range(3000))
    texts = [None, "", " ", "hello world", "hello world", long]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "x", None, None)], "doc_id bigint, text string, ids string, n_tokens int")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df).collect()}
    assert got == {**{i: theirs(t or "") for i, t in enumerate(texts)}, None: theirs("x")}
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert bpe.encode_corpus(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_blocks_and_caches_start_anew(theirs, monkeypatch):
    s = bpe.Speculator(bpe.DEFAULT_TOKENIZER)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 10)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdest ") for _ in range(r.randrange(900))) for _ in range(30)] + [None, ""]
    got = []
    for _, _, tokens, n in s.blocks(texts):
        at = 0
        for k in n:
            got.append(tokens[at : at + k].tolist())
            at += k
    assert got == [theirs(t or "") for t in texts]
