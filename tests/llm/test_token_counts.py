import json
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.frames import read
from tidemark.llm.merging import TextEncoder, encoder_of
from tidemark.llm.token_counts import token_counts
from tidemark.llm.vocab import read_json_bpe

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
ENCODER = TextEncoder(read_json_bpe(P.path("byte_bpe_50k.json")), P.PATTERN)


def ids(text):
    return next(ENCODER.id_arrays([text])).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'aelstvdm1!é漢🙂"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_librarys(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" a", "a ", " ", "a b\n c d", "a\n b", "a  b c", "a \n  b", "x\u00a0 y z", "\n a b c", "a b\n", "\x1c x \x1cy z", "", "a" * 5000, " " * 999 + "x", "x<|endoftext|>y <|endoftext|>", "aaa aaaa aaaaa", "\r\n\r\n    z"])
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t.'\u00a0\x1c1"), max_size=30), max_size=8))
def test_texts_of_one_run(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [a.tolist() for a in ENCODER.id_arrays(texts, 40)] == want
    assert list(ENCODER.counts(texts, 40)) == [len(w) for w in want]


def test_memory_starts_anew():
    encoder = TextEncoder(read_json_bpe(P.path("byte_bpe_50k.json")), P.PATTERN)
    encoder.REMEMBERED = 50
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(30)]
    assert list(encoder.counts(texts, 200)) == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect()}
    want = {}
    for r in docs.collect():
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 512)
    assert got == want


def test_edges(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "hi there", 6), (2, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, token_counts(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 8, 2, False), (2, 0, 0, False)], key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_vocabularies_that_agree_in_their_counts_are_told_apart(tmp_path):
    """Two files with as many merges and the same last one have an encoder each."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    own = tmp_path / "own.json"
    own.write_text(json.dumps(spec), encoding="utf-8")
    a, b = (encoder_of(read_json_bpe(path), P.PATTERN) for path in (P.path("byte_bpe_50k.json"), str(own)))
    assert a is not b and a is encoder_of(read_json_bpe(P.path("byte_bpe_50k.json")), P.PATTERN)
