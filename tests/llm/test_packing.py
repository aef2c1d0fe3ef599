import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm.frames import read
from tidemark.llm.packing import first_fit_decreasing, numbered, pack


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 80))]
        where, offset = first_fit_decreasing(sizes, 100)
        rooms, want = [], [None] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            b = next((i for i, room in enumerate(rooms) if room >= sizes[k]), None)
            if b is None:
                rooms.append(100)
                b = len(rooms) - 1
            want[k] = (b, 100 - rooms[b])
            rooms[b] -= sizes[k]
        assert list(zip(where, offset, strict=True)) == want


def check(rows, texts, capacity):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert len(part) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    rows = pack(docs).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert sum(r.length for r in rows) / (2048 * n) > 0.98


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "one two three " * 40, 3)], "doc_id long, text string, length int")
    rows = pack(df, capacity=16, group_size=2).collect()
    check(rows, {1: None, 2: "", 3: "one two three " * 40}, 16)
    assert pack(df.limit(0)).count() == 0
    twice = df.unionAll(df).unionAll(spark.createDataFrame([(None, "x", 1)] * 2, df.schema))
    assert sum(r.length for r in pack(twice, capacity=16).collect()) == 2 * sum(r.length for r in rows) + 4


def test_one_id_in_many_rows(spark):
    """Rows with one id, equal ones too, are spread over the groups."""
    df = spark.createDataFrame([(7, f"text number {k % 50}") for k in range(2000)], "doc_id long, text string").repartition(8)
    rows = pack(df, group_size=100).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 2000 and len(sizes) == 20 and max(sizes.values()) < 300


def test_splits_do_not_matter(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(20)).unionByName(spark.range(300).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text"))
    one, other = (sorted(map(str, pack(docs.repartition(n), group_size=64).collect())) for n in (1, 7))
    assert one == other


def test_copies_are_numbered_in_blocks(spark):
    pieces = spark.range(10_000).selectExpr("1L AS id", "0L AS start", "5L AS length", "7L AS ids_crc32", "5L AS doc_tokens").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 0L AS start, 1L AS length, 2L AS ids_crc32, 1L AS doc_tokens"))
    rows = numbered(pieces).collect()
    assert sorted(r["copy"] for r in rows if r.id == 1) == list(range(10_000)) and [r["copy"] for r in rows if r.id is None] == [0]
    assert numbered(pieces.limit(0)).count() == 0
