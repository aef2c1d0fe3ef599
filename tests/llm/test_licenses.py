import math
import random
import re

import duckdb
import pytest

from tidemark.llm import licenses
from tidemark.llm.frames import read
from tidemark.llm.licenses import PHRASES, STEP, TEMPLATES, WINDOW, license_labels, license_sql, scan_licenses


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(doc_id, text, threshold=0.8):
    words = words_of(text)
    places = [(k, label) for label, p in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    score, found = 1.0 if places else 0.0, set()
    for start in range(0, len(words), STEP):
        block = set(words[start : start + WINDOW])
        for label, t in TEMPLATES:
            tokens = set(t.split())
            share = len(tokens & block) / len(tokens)
            if len(tokens & block) >= math.ceil(round(threshold * len(tokens), 9)):
                found.add(label)
                score = max(score, share)
    base = {label for _, label in places}
    starts = [k for k, _ in places]
    return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def noisy(rng):
    """Notices with words lost, changed, doubled and put apart, among words of prose and of other licenses."""
    out = []
    for _ in range(rng.randint(0, 6)):
        words = rng.choice(TEMPLATES + PHRASES)[1].split()
        kept = [w for w in words if rng.random() > rng.choice([0, 0.1, 0.25])]
        if rng.random() < 0.3:
            rng.shuffle(kept)
        for w in kept:
            out += [w.upper() if rng.random() < 0.2 else w] + ["filler"] * (rng.random() < 0.1)
        out += [rng.choice(["word", "the", "license", "under", "by", "nc", "été", "42"]) for _ in range(rng.randint(0, 60))]
    return "".join(w + rng.choice([" ", " ", ", ", "\n", "-", "　 "]) for w in out)


def test_equals_every_block_against_every_template(spark):
    rng = random.Random(7)
    rows = [(k, noisy(rng)) for k in range(300)]
    got = ordered(license_labels(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    want = ordered(plain(*r) for r in rows)
    assert got == want and len({r[6] for r in want}) > 10


def test_whole_table_and_sql(spark, sf):
    df = read(spark, sf, "documents")
    got = ordered(license_labels(df).collect())
    assert got == ordered(plain(r.doc_id, r.text) for r in df.collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert ordered(con.sql(license_sql()).fetchall()) == got


def test_odd_rows(spark):
    mit = "Under the MIT License."
    rows = [(1, mit), (1, mit), (1, "cc-by/nc " * 3), (2, None), (3, ""), (4, "..."), (None, mit), (None, None), (5, "under the MIT license"), (6, "x " * 31 + "Apache License, Version 2.0" + " y" * 200_000 + " " + TEMPLATES[9][1])]
    df = spark.createDataFrame([(*r, 3, "b", "l") for r in rows], "doc_id long, text string, n_words int, blocks string, labels string").repartition(3)
    assert ordered(license_labels(df).collect()) == ordered(plain(*r) for r in rows)
    assert license_labels(df.limit(0)).collect() == []
    spans = [r for r in scan_licenses(df).collect() if r.doc_id == 6]
    assert [tuple(p) for p in spans[0].places] == [(31, "apache-2")] and {b.label for b in spans[0].blocks} == {"gpl"}
    with pytest.raises(ValueError):
        scan_licenses(df, templates=(("long", "w " * (WINDOW - STEP + 1)),))


def test_frequent_words_come_last(spark, monkeypatch):
    """The blocks that reach the join are those with a rare word of a template."""
    seen = {}
    blocks = licenses._blocks
    monkeypatch.setattr(licenses, "_blocks", lambda texts, order, begins, least: seen.update(order=order, begins=begins) or blocks(texts, order, begins, least))
    rows = [(k, "the license of this and that by any or the terms " * 5) for k in range(50)] + [(99, "under the mit license")]
    license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not {b"the", b"license", b"this", b"or", b"terms"} & seen["begins"] and seen["order"][b"the"] > seen["order"][b"mit"]
