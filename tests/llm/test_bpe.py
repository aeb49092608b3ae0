import os
import random

import numpy as np
import pytest

from rankloom.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import tiktoken

    own = bpe.ByteBPE.read(PATH)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def encoded(own, texts):
    ids, n = own.encode(texts)
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n)]


def test_equals_a_library_on_random_text(both):
    own, lib = both
    rnd = random.Random(3)
    letters = "ab'stredvlm '' \n\t  12.,!éñ日本　 ДеX'\x85😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["", "a" * 3000, "'s'll've", "  ", "x" * 100 + " " * 50, "<|endoftext|>"]
    assert encoded(own, texts) == [lib.encode_ordinary(t) for t in texts]


def test_null_and_empty_have_no_ids(both):
    assert encoded(both[0], [None, "", "a", None]) == [[], [], [64], []]
    assert encoded(both[0], []) == []


def test_long_texts_are_cut_only_where_tokens_end(both, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 37)
    text = "It's  a long   text,\n\n with 1234 things'll and  " * 40
    assert encoded(both[0], [text, "x", text]) == [both[1].encode_ordinary(t) for t in (text, "x", text)]


def test_every_token_is_reached_and_hashed_to_its_own_slot(both):
    own = both[0]
    some = list(own.ranks.items())[::97]
    assert [own.merge(t) for t, _ in some] == [[i] for _, i in some]
    assert sorted(own.hash(own.hashes).tolist()) == list(range(len(own.ranks)))


def test_perfect_hash_of_few_and_of_equal_keys():
    for n in (1, 2, 7, 500):
        keys = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
        assert sorted(bpe.PerfectHash(keys)(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([1, 1], np.uint64))


def test_operator(spark, both):
    from rankloom.llm.tokens import encode

    df = spark.createDataFrame([(1, "Hello world", 7), (2, None, 7), (None, "", 7), (2, "Hello world", 8)], "doc_id long, text string, ids int")
    got = encode(df).orderBy("doc_id", "text").collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == [(None, []), (1, both[1].encode_ordinary("Hello world")), (2, []), (2, both[1].encode_ordinary("Hello world"))]
    assert encode(df.limit(0)).count() == 0
