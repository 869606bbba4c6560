"""Pieces, merges and the frequency cutoff of the tokenizer operators."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest
from lanternflow.llm import common, lexicon, queries, tokenfiles


@pytest.fixture(scope="module")
def bpe():
    return lexicon.Bpe(queries.tokenizer_path())


def odd_texts():
    rng = random.Random(9)
    signs = "ab yZ.,;-_!?<>|'\"0123 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éÜßİıſΣς́中文字😀​½²"
    out = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(400)]
    return out + ["", None, " ", "a.b, c. D.\nE", "x_. y", "é. Ü, ß.", "<|endoftext|> a", "A" * 300 + ". " + "b" * 300]


def test_pieces_give_the_ids_of_the_library(bpe):
    texts = odd_texts()
    codec, encoder = lexicon.Codec(queries.tokenizer_path(), lexicon.Lexicon.compile({b"a": bpe.merge(b"a")})), tokenfiles._Encoder(queries.tokenizer_path(), 2)
    for _ in range(2):  # the second time from the cache
        got = list(codec.many(pa.array(texts, pa.string())))
        packed = [np.frombuffer(bytes(x), "<u2").tolist() for x in encoder.many(pa.array(texts, pa.string()))]
        for text, (n, ids, decoded), numbers in zip(texts, got, packed):
            want = bpe.library.encode(text or "", add_special_tokens=False).ids
            assert (n, bytes(ids).decode()) == (len(want), " ".join(map(str, want))) and numbers == want, repr(text)
            assert bytes(decoded).decode() == bpe.library.decode(want, skip_special_tokens=False)


def test_long_merges_equal_short_ones_and_the_library(bpe):
    rng = random.Random(4)
    for n in (1, 2, 25, 26, 300, 2000):
        word = "".join(rng.choices("aabcdeinorst", k=n))
        parts = [*[bpe.vocab[c] for c in word[:-1]], bpe.vocab[word[-1] + bpe.end]]
        assert bpe._merge_long(list(parts)) == bpe._merge_short(list(parts))
        assert bpe.merge(word.encode()) == bpe.merge_unseen(word.encode()) == bpe.library.encode(word, add_special_tokens=False).ids


def test_word_of_a_million_letters(spark, bpe):
    word = "".join(random.Random(1).choices(string.ascii_lowercase, k=1_000_000))
    rows = spark.createDataFrame([(1, word), (2, word + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in lexicon.encode_decode(rows, queries.tokenizer_path()).collect()}
    want = bpe.library.encode(word, add_special_tokens=False).ids
    assert got[1] == want and got[2] == want + bpe.library.encode("end", add_special_tokens=False).ids


def test_cache_is_bounded_by_bytes():
    made = []
    cache = common.Recent(lambda ks: [made.append(k) or k * 2 for k in ks], lambda k, v: len(k) + len(v), most=30_000)
    for i in range(5_000):
        keys = [str(i), "x" * 3, "long" * 100]
        assert cache.fetch(keys) == [k * 2 for k in keys]
    size = lambda d: sum(len(k) + len(v) for k, v in d.items())
    assert size(cache.young) + size(cache.old) < 61_000 and made.count("xxx") == 1 and made.count("long" * 100) == 5_000


@pytest.mark.parametrize("most", [0, 1, 3, 7, 50, 1000])
def test_cutoff_keeps_as_many_words_as_fit(spark, most):
    rng = random.Random(most)
    counts = [rng.choice([1, 1, 1, 2, 5, 5, 9, 1000, 10 ** 6]) for _ in range(60)]
    c = lexicon.cutoff(spark.createDataFrame([(n,) for n in counts], "n long"), most, ways=4)
    assert sum(n > c for n in counts) <= most and (c == 0 or sum(n > c - 1 for n in counts) > most)
