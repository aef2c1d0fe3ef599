"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut
from tidemark.session import ship

#: Phrases that are licenses by themselves where their words stand consecutively, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Sentences of the licenses' own notices, at most ``WINDOW - STEP`` words each, and their labels.
TEMPLATES = (
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's words that a block holds at least.
THRESHOLD = 0.8
#: Words of a block, and from one block's start to the next.
WINDOW, STEP = 64, 32

#: Bytes to lower case; all that is neither a digit nor a letter nor part of a character beyond ASCII to a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, check, text): ids, two hashes of the texts, and their bytes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), F.hash(text).alias("check"), text.cast("binary").alias("text"))


def _wanted(phrases, templates, threshold: float) -> list[dict]:
    """What is sought: words in order, distinct words, and how many of these a block must hold."""
    out = []
    for kind, rows, share in (("phrase", phrases, 1.0), ("template", templates, threshold)):
        for label, text in rows:
            words = text.split()
            if not words or len(words) > WINDOW - STEP:
                raise ValueError(f"a phrase or template has 1 to {WINDOW - STEP} words: {text!r}")
            # A share as written, not as a binary fraction: 0.8 of 15 words are 12.
            out.append({"kind": kind, "label": label, "words": words, "least": math.ceil(round(share * len(set(words)), 9))})
    return out


def _frequencies(texts: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the vocabulary stands: at most one row a word and batch is shuffled."""

    def count(batches):
        for batch in batches:
            seen = dict.fromkeys(vocabulary, 0)
            for text in batch.column(0):
                for word in vocabulary.intersection(text.as_py().translate(_WORDS).split()):
                    seen[word] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def _blocks(texts: DataFrame, order: dict[bytes, int], begins: frozenset[bytes], least: int) -> DataFrame:
    """Each text's number of words and the blocks that may match: those with a word that a template's prefix has, and ``least`` words of the templates.

    A block has its words' places in the global order, -1 for words of no template.
    """

    def scan(batches):
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(3):
                words = text.as_py().translate(_WORDS).split()
                sizes.append(len(words))
                starts = {k for p, w in enumerate(words) if w in begins for k in (p // STEP * STEP, p // STEP * STEP - STEP) if k >= 0 and p < k + WINDOW}
                own = []
                for start in sorted(starts):
                    codes = [order.get(w, -1) for w in words[start : start + WINDOW]]
                    if len(set(codes) - {-1}) >= least:
                        own.append({"start": start, "codes": codes})
                found.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("codes", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(found, kind)], ["id", "h", "check", "n_words", "blocks"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"id {id_type}, h long, check int, n_words long, blocks array<struct<start: bigint, codes: array<int>>>")


def _index(spark, wanted: list[dict], order: dict[bytes, int]) -> DataFrame:
    """(token, kind, label, place, tokens, phrase, least): a row for each word of each template's prefix, of all there are a few hundred."""
    rows = []
    for w in wanted:
        phrase = [order[x.encode()] for x in w["words"]]
        tokens = sorted(set(phrase))
        rows += [(token, w["kind"], w["label"], place, tokens, phrase, w["least"]) for place, token in enumerate(tokens[: len(tokens) - w["least"] + 1])]
    return spark.createDataFrame(rows, "token int, kind string, label string, place int, tokens array<int>, phrase array<int>, least int")


def matches(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """``blocks``' rows (start, codes and others) with the templates that they contain: kind, label, containment, and places of phrases.

    Words are numbered from the rarest in the corpus up. A block and a
    template that share enough words share one within both prefixes, so the
    join by the words of prefixes finds all pairs. Of a pair's common words
    only the first makes a row; it passes if the words behind it suffice on
    both sides, and if the exact count of common words does.
    """
    sets = blocks.withColumn("own", F.array_sort(F.array_distinct(F.filter("codes", lambda c: c >= 0))))
    dealt = sets.select("*", F.posexplode("own").alias("at", "token"))
    pairs = dealt.join(F.broadcast(index), "token")
    common = F.array_intersect("own", "tokens")
    left = F.least(F.size("own") - F.col("at"), F.size("tokens") - F.col("place"))
    pairs = pairs.where((F.size("own") >= F.col("least")) & (left >= F.col("least"))).where((F.array_min(common) == F.col("token")) & (F.size(common) >= F.col("least")))
    starts = F.filter(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda k: F.slice("codes", k + 1, F.size("phrase")) == F.col("phrase"))
    places = F.when(F.col("kind") == "phrase", F.transform(starts, lambda k: F.col("start") + k))
    found = pairs.select("*", (F.size(common) / F.size("tokens")).alias("containment"), places.alias("places"))
    return found.where("kind = 'template' or size(places) > 0").drop("token", "own", "at", "place", "tokens", "phrase", "least", "codes")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row its id, n_words, ``places`` of phrases (start, label) and ``blocks`` that contain a template (start, label, containment), sorted.

    Words are the runs of digits, letters and characters beyond ASCII of the
    text with A-Z lowered. A place is a word, from 0, at which a phrase's
    words stand consecutively. Blocks are the ``WINDOW`` words from every
    ``STEP``-th word on; one contains a template if it holds ``threshold`` of
    the template's distinct words. As blocks overlap by more words than a
    phrase or template has, none falls between two blocks; a phrase's place
    counts in the block whose first ``STEP`` words it is among.

    Two passes over the texts, on Arrow batches: one counts in how many texts
    the templates' words stand, which orders them, one finds the blocks that
    share a word with a template's prefix. What is joined by word, length and
    place are these blocks, with the templates, whose number is a parameter.
    What is found is joined to the rows by id and two hashes of the text.

    A null or empty text has no words and no finds; a null id stays null and
    has its finds; repeated rows each have theirs. No size of a text changes
    anything, a longer one has more blocks. An empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    wanted = _wanted(phrases, templates, threshold)
    texts = _texts(df, id_col, text_col)
    vocabulary = frozenset(w.encode() for x in wanted for w in x["words"])
    count = _frequencies(texts, vocabulary)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    name = {k: w for w, k in order.items()}
    index = _index(spark, wanted, order)
    begins = frozenset(name[r["token"]] for r in index.select("token").distinct().collect())
    rows = cut(_blocks(texts, order, begins, min(w["least"] for w in wanted)))
    found = matches(rows.select("id", "h", "check", F.explode("blocks").alias("b")).select("id", "h", "check", "b.start", "b.codes"), index)
    hits = found.groupBy("id", "h", "check").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("places", lambda p: F.struct(p.alias("start"), F.col("label").alias("label"))))))).alias("places"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "template", F.struct("start", "label", "containment")))).alias("blocks"),
    )
    hits = hits.select(F.col("id").alias("hit_id"), F.col("h").alias("hit_h"), F.col("check").alias("hit_check"), "places", F.col("blocks").alias("hit_blocks"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")) & (F.col("check") == F.col("hit_check"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    joined = rows.drop("blocks").join(hits.withColumnRenamed("hit_blocks", "blocks"), same, "left")
    return joined.select(F.col("id").alias(id_col), "n_words", none("places", "array<struct<start:bigint,label:string>>"), none("blocks", "array<struct<start:bigint,label:string,containment:double>>"))


def license_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per row: n_words, the number of phrases' places, their first and last word, the phrases' labels, all labels, and a score.

    ``df`` and ``more`` as for :func:`scan_licenses`. Labels are sorted and
    joined by commas, empty where there are none. The score is 1 with a
    phrase, else the highest containment of a template, else 0.
    """
    joined = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(p, lambda x: x["label"]) for p in parts]))), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return scan_licenses(df, id_col, text_col, **more).select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        joined("places").alias("base_labels"),
        joined("places", "blocks").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def license_sql(phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """SQL that gives the rows of :func:`license_labels` over ``documents``, every block against every template."""
    wanted = [
        f"('{w['kind']}', '{w['label']}', {w['words']!r}, {sorted(set(w['words']))!r}, {w['least']})" for w in _wanted(phrases, templates, threshold)
    ]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH wanted(kind, label, phrase, tokens, least) AS (VALUES {", ".join(wanted)}),
d AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT row_no, start, list_slice(words, start + 1, start + {WINDOW}) AS block
  FROM (SELECT row_no, words, unnest(range(0, len(words), {STEP})) AS start FROM d)
), m AS (
  SELECT row_no, start, kind, label, len(list_filter(tokens, lambda t: list_contains(block, t))) / len(tokens) AS containment,
         CASE WHEN kind = 'phrase' THEN list_filter(range(0, {STEP}), lambda k: list_slice(block, k + 1, k + len(phrase)) = phrase) END AS places
  FROM b, wanted
  WHERE len(list_filter(tokens, lambda t: list_contains(block, t))) >= least
), f AS (
  SELECT row_no, sum(len(places)) FILTER (WHERE kind = 'phrase') AS n_base, min(start + list_min(places)) AS first_word, max(start + list_max(places)) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'phrase') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(CASE WHEN kind = 'phrase' THEN 1.0 ELSE containment END) AS score
  FROM m WHERE kind = 'template' OR len(places) > 0 GROUP BY row_no
)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f USING (row_no)
"""
