import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm.byte_bpe import decode, encode, round_trip
from tidemark.llm.frames import read

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "a", "\n\n  x", "don't we'll I'd THEY'RE", "x" * 700, " " * 50 + "\t\r\n", "<|endoftext|>", "日本語 テスト　全角", "🙂🙃 é è ñ\u0085z", "12345678901234 3.14,15"]
    pool = "etaoin shrdlu.,'\n0123éß漢🙂!"
    return out + ["".join(rng.choices(pool, k=rng.randint(1, 200))) for _ in range(60)]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_ids_are_the_librarys(spark, frequent):
    rows = list(enumerate(texts())) + [(None, "a b a b")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, words int")
    out = decode(encode(df, frequent=frequent), "ids", "back")
    assert out.columns == ["doc_id", "text", "words", "ids", "back"]
    for r in out.collect():
        assert r.ids == LIBRARY.encode_ordinary(r.text or ""), r.text
        assert bytes(r.back) == (r.text or "").encode()


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in round_trip(docs).collect()}
    want = {}
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(df).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.back for r in decode(nothing, "ids", "back").collect()] == [None, bytearray()]


def long_words():
    rng = random.Random(5)
    letters = lambda n, pool: "".join(rng.choices(pool, k=n))
    out = [letters(n, "etaoinshrdlu") for n in (255, 256, 257, 511, 512, 513, 767, 768, 769, 1025, 3000)]
    out += [letters(5000, "abcdefghijklmnopqrstuvwxyz"), letters(2000, "漢字日本語é"), letters(1500, "01"), letters(1200, "-=_*#")]
    out += ["a" * 3000, "ab" * 1500, "=" * 2000, " " * 1800 + "x", "-" * 700, "Ã" * 900, "=" * 300 + letters(600, "=-") + "=" * 700]
    return out


def test_long_words(spark):
    df = spark.createDataFrame(list(enumerate(long_words())), "doc_id long, text string")
    for r in encode(df, frequent=0).collect():
        assert r.ids == LIBRARY.encode_ordinary(r.text), r.text[:40]


def test_a_word_of_a_hundred_thousand_letters(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "ab" * 50_000]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    for r in encode(df, frequent=0).collect():
        # The library itself takes time with the square of a word's length, but not for that of its tokens' text.
        assert LIBRARY.decode(r.ids) == words[r.doc_id]
        assert all(LIBRARY.encode_ordinary(LIBRARY.decode(r.ids[k : k + 2])) == r.ids[k : k + 2] for k in range(0, len(r.ids) - 1, 97))


def test_hostile_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "the cat", 2, "t"), (1, "the cat", 2, "t"), (None, None, None, None)], "doc_id long, text string, tables_ int, digits string")
    rows = encode(df).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == [(0, []), (1, LIBRARY.encode_ordinary("the cat"))] + [(1, LIBRARY.encode_ordinary("the cat"))]
    assert round_trip(df).count() == 3
