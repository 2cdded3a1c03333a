import random

import pytest
import tiktoken

from asterweave.llm import tokens


@pytest.fixture(scope="module")
def both():
    enc = tokens.encoder()
    return enc, tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=enc.ranks, special_tokens={})


def test_random_texts(both):
    enc, ref = both
    rnd = random.Random(7)
    for alphabet in ("abeinrst", "ab \n\t'sé漢😀01.,", "aaab"):
        for _ in range(400):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200)))
            assert enc.encode(text) == ref.encode_ordinary(text)


def test_all_bytes_and_special_strings(both):
    enc, ref = both
    for text in ("<|endoftext|>", "".join(map(chr, range(1, 600))), "\r\n   x", "a" * 5000, " " * 5000, "\x00\x01"):
        assert enc.encode(text) == ref.encode_ordinary(text)


def test_long_piece_is_not_quadratic(both):
    enc, _ = both
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    ids = enc.encode(text)
    back = {v: k for k, v in enc.ranks.items()}
    assert b"".join(back[i] for i in ids) == text.encode()


def test_operator(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Zażółć\r\n"), (None, "x"), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as tokens")
    got = [(r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect()]
    assert (1, [15496, 995]) in got and (2, []) in got and (3, []) in got and len(got) == 6
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}
    assert counts[1] == 2 and counts[2] == 0 and counts[3] == 0
    assert tokens.token_ids(df.limit(0)).count() == 0
