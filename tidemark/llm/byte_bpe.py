"""Byte-level BPE in Spark's own functions: encoding by ranked merges, and decoding.

While a word is folded, each of its tokens is one character, at ``TOKEN`` plus
its id, so that a step is a few functions of strings. A pair of tokens that
together are a token is merged into the character of that token, whose id is
the pair's rank: the lowest rank is the least character.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import cut
from tidemark.llm.vocab import default_path, read_ranks

#: Tokens' characters begin here; ids end where Unicode does.
TOKEN, IDS = 0x10000, 0x100000 - 16
#: What stands for no rank, and what stands at both ends of a word.
NONE, EDGE = "\U0010ffff", "\U0010fffd"
#: Places, a power of two, of the table of pairs, most of which are empty.
PAIR_PLACES = 1 << 18
#: Bytes of a word that are folded at a time, and the step to the next such part of a longer word.
PART, STRIDE = 512, 256
#: Words that are encoded beforehand, at most, and the places of their table.
FREQUENT, WORD_PLACES = 1 << 18, 1 << 17


def _let(value: Column, body, kind: str = "string") -> Column:
    """``body(value)`` with ``value`` computed once and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value.cast(kind), lambda v, _: v, body)


def _char(token: int) -> str:
    return chr(TOKEN + token)


def _place(key: Column, places: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(places - 1)).cast("int")


def _unreached(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens that merging their bytes, without the last merge's shortcut, doesn't give."""
    out = []
    for token, rank in ranks.items():
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best, at = min(((ranks.get(parts[k] + parts[k + 1], IDS), k) for k in range(len(parts) - 1)), default=(IDS, 0))
            if best == IDS:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1 or ranks[parts[0]] != rank:
            out.append(token)
    return out


def _tables(ranks: dict[bytes, int]) -> pa.Table:
    """One row of tables: the pairs of token characters and what they make, by a hash; the tokens' lengths by id; the bytes' tokens; whole words that merges don't give."""
    if max(ranks.values()) >= IDS:
        raise ValueError(f"ids of {IDS:,} and more have no character")
    places: list[list[tuple[str, str]] | None] = [None] * PAIR_PLACES
    lengths = [0] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pair = _char(a) + _char(b)
                place = xxhash.xxh64_intdigest(pair.encode(), 42) % PAIR_PLACES
                places[place] = [*(places[place] or []), (pair, _char(rank))]
    whole = [(base64.b64encode(t).decode(), _char(ranks[t])) for t in _unreached(ranks)]
    pairs = pa.array([places], pa.list_(pa.map_(pa.string(), pa.string())))
    row = {"pairs": pairs, "lengths": pa.array([lengths], pa.list_(pa.int32())), "letters": pa.array(["".join(_char(ranks[bytes((b,))]) for b in range(256))]), "whole": pa.array([whole], pa.map_(pa.string(), pa.string()))}
    return pa.table(row)


def _value(spark: SparkSession, row: pa.Table) -> Column:
    """A one-row table's columns as a value: they reach the tasks as one block of bytes, not as many objects."""
    return cut(spark.createDataFrame(row).coalesce(1).select(F.struct(*row.column_names).alias("t"))).scalar()


def _with(df: DataFrame, name: str, values: dict[str, Column], body) -> DataFrame:
    """``df`` with ``body`` of the ``values`` as column ``name``.

    Functions of arrays take no subqueries, so each value is a column first;
    read once only, it is folded into its reader and is a value of the plan,
    not of the rows.
    """
    held = {}
    for k in values:
        own = f"{k}_"
        while own in df.columns or own == name:
            own += "_"
        held[k] = own
    rows = df.withColumns({held[k]: v for k, v in values.items()})
    bound = F.transform(F.array(F.struct(*[F.col(own).alias(k) for k, own in held.items()])), body)[0]
    return rows.withColumn(name, bound).drop(*held.values())


def _rank(pair: Column, tables: Column) -> Column:
    """The character of what a pair of characters makes, or ``NONE``."""
    return F.coalesce(F.element_at(F.get(tables["pairs"], _place(pair, PAIR_PLACES)), pair), F.lit(NONE))


def _letters(raw: Column, tables: Column) -> Column:
    """Bytes as the characters of their tokens."""
    return F.call_function("translate", F.decode(raw, "ISO-8859-1"), F.lit("".join(map(chr, range(256)))), tables["letters"])


def _fold(raw: Column, tables: Column) -> Column:
    """A fold over the tokens of some bytes: their characters.

    The state holds them, between two edges, and the ranks of the pairs they
    form. A step replaces the leftmost pair of lowest rank and looks up the
    two pairs beside it; steps after the last merge leave the state as it is.
    """

    def step(state: Column, _: Column) -> Column:
        s, r = state["s"], state["r"]

        def merge(m: Column) -> Column:
            def put(left: Column) -> Column:
                def made(s: Column) -> Column:
                    def beside(three: Column) -> Column:
                        two = F.concat(_rank(F.substring(three, 1, 2), tables), _rank(F.substring(three, 2, 2), tables))
                        return F.struct(s.alias("s"), F.overlay(r, two, left, F.lit(3)).alias("r"))

                    return _let(F.substring(s, left, F.lit(3)), beside)

                return _let(F.overlay(s, m, left + 1, F.lit(2)), made)

            return F.when(m == NONE, state).otherwise(_let(F.instr(r, m) - 1, put, "int"))

        return _let(F.array_min(F.split(r, "")), merge)

    def start(s: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda k: _rank(F.substring(s, k, F.lit(2)), tables))
        return F.struct(s.alias("s"), F.array_join(ranks, "").alias("r"))

    size = F.octet_length(raw)
    whole = _let(F.concat(F.lit(EDGE), _letters(raw, tables), F.lit(EDGE)), start)
    return F.aggregate(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), whole, step, lambda state: F.replace(state["s"], F.lit(EDGE), F.lit("")))


def _fold_runs(raw: Column, tables: Column) -> Column:
    """The same with all places of the lowest rank merged in one step, from the left: as many steps with work as there are ranks."""

    def step(state: Column, _: Column) -> Column:
        def ranked(c: Column) -> Column:
            pairs = F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.when(b.isNull(), F.lit(NONE)).otherwise(_rank(F.concat(a, b), tables)))

            def merge(held: Column) -> Column:
                m = held["m"]
                marked = F.array_join(F.zip_with(c, held["r"], lambda a, r: F.when(r == m, F.concat(a, F.lit(EDGE))).otherwise(a)), "")
                made = F.replace(F.regexp_replace(marked, F.lit(f".{EDGE}."), m), F.lit(EDGE), F.lit(""))
                return F.when(m == NONE, F.struct(state["s"].alias("s"), F.lit(True).alias("done"))).otherwise(F.struct(made.alias("s"), F.lit(False).alias("done")))

            return _let(_let(pairs, lambda r: F.struct(r.alias("r"), F.array_min(r).alias("m")), "array<string>"), merge, "struct<r:array<string>,m:string>")

        return F.when(state["done"], state).otherwise(_let(F.split(state["s"], ""), ranked, "array<string>"))

    start = F.struct(_letters(raw, tables).alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(2), F.octet_length(raw)), start, step, lambda state: state["s"])


def _id(char: Column) -> Column:
    return F.ascii(char) - TOKEN


def _fold_parts(raw: Column, tables: Column) -> Column:
    """The ids of a long word, from folds of parts that overlap by half: work in proportion to its length.

    Tokens in a row are what merging gives if and only if each two neighbours
    are what merging the two's bytes gives. So where neighbouring parts have
    the same token at the same place, the first part's tokens before it and
    the second's from it on are those of the whole. Parts without a common
    token, as in long runs of one letter, send the word to ``_fold_runs``.
    """
    size = F.octet_length(raw)

    def part(o: Column) -> Column:
        """A part's tokens, each as its place in the word and its id in one number."""
        put = lambda a, c: F.struct((a["at"] + F.get(tables["lengths"], _id(c))).alias("at"), F.concat(a["out"], F.array(a["at"] * (1 << 20) + _id(c))).alias("out"))
        start = F.struct(o.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.split(_fold(F.substring(raw, o + 1, F.lit(PART)), tables), ""), start, put, lambda a: a["out"])

    def joined(parts: Column) -> Column:
        def spliced(seams: Column) -> Column:
            """``seams``: the first common token of each part and the next."""
            own = lambda p, k: F.filter(p, lambda x: (x >= F.coalesce(F.get(seams, k - 1), F.lit(-1))) & (x < F.coalesce(F.get(seams, k), F.lit((1 << 63) - 1))))
            ids = F.transform(F.flatten(F.transform(parts, own)), lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))
            runs = F.transform(F.split(_fold_runs(raw, tables), ""), _id)
            return F.when(F.exists(seams, lambda x: x.isNull()), runs).otherwise(ids)

        seams = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: F.array_min(F.array_intersect(F.get(parts, k), F.get(parts, k + 1))))
        return _let(seams, spliced, "array<bigint>")

    return _let(F.transform(F.sequence(F.lit(0), size - STRIDE - 1, F.lit(STRIDE)), part), joined, "array<array<bigint>>")


def encode_word(word: Column, tables: Column) -> Column:
    """A pre-token's ids. A word that is a token is that one, also if merges don't give it."""

    def of(raw: Column) -> Column:
        own = F.element_at(tables["whole"], F.base64(raw))
        short = F.transform(F.split(_fold(raw, tables), ""), _id)
        return F.when(own.isNotNull(), F.array(_id(own))).when(F.octet_length(raw) <= PART, short).otherwise(_fold_parts(raw, tables))

    return _let(word.cast("binary"), of, "binary")


def as_text(ids: Column) -> Column:
    """Ids in decimal digits, a space between them."""
    return F.array_join(ids.cast("array<string>"), " ")


def split_words(text: Column, pattern: str) -> Column:
    """The matches of the pre-token pattern, white space as Unicode has it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(words: DataFrame, tables: Column, most: int = FREQUENT) -> Column:
    """The ids of the corpus' most frequent words, as a value that every task holds.

    Counts cover all of ``words`` (one array a row, in column ``words``). The
    words from a count on, ``most`` of them at most, are encoded once and
    gathered by a hash: the table's size does not grow with the corpus.
    """
    counts = cut(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    # Levels of an eighth of a doubling, so that the driver sees some hundreds of numbers.
    level = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.col("level").desc()).collect():
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    chosen = counts.where(level >= least) if least is not None else counts.where("false")
    place = _place(F.col("word"), WORD_PLACES)
    encoded = _with(chosen.select(place.alias("place"), "word"), "ids", {"tables": tables}, lambda v: as_text(encode_word(F.col("word"), v["tables"])))
    maps = encoded.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("word", "ids"))).alias("m"))
    every = counts.sparkSession.range(WORD_PLACES).select(F.col("id").cast("int").alias("place")).join(maps, "place", "left")
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.map_keys("m"), F.array().cast("array<string>")).alias("k"), F.coalesce(F.map_values("m"), F.array().cast("array<string>")).alias("v")))), lambda p: F.map_from_arrays(p["k"], p["v"])).alias("t"))
    return row.scalar()


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None, frequent: int = FREQUENT, text_ids_col: str | None = None) -> DataFrame:
    """``df`` with each text's token ids (array<int>) in ``ids_col`` and, if asked for, in ``text_ids_col`` as decimal text.

    Words (pre-tokens) are encoded by a fold over their bytes with the rank
    tables, literals, as values of the plan. The distinct words of the corpus
    are counted first, and the frequent ones, a number bounded by
    ``frequent``, encoded once; a text looks its words up and folds the rare
    ones itself. So texts are never shuffled, whatever the number of distinct
    words.

    A null text gives no ids, as an empty one does. Special strings are
    ordinary text. Repeated rows each get theirs; an empty table stays empty.
    """
    import public_tokenizers

    tables = _value(df.sparkSession, _tables(read_ranks(ranks or default_path("byte_bpe_50k.tiktoken"))))
    words = split_words(F.col(f"`{text_col}`").cast("string"), pattern or public_tokenizers.PATTERN)
    known = frequent_words(df.select(words.alias("words")), tables, frequent)

    def ids_of(values: Column) -> Column:
        def one(word: Column) -> Column:
            return F.coalesce(F.element_at(F.get(values["seen"], _place(word, WORD_PLACES)), word), as_text(encode_word(word, values["tables"])))

        return F.array_join(F.transform(words, lambda w: one(w)), " ")

    digits = text_ids_col or "digits"
    while digits in df.columns and digits != text_ids_col:
        digits += "_"
    out = _with(df, digits, {"seen": known, "tables": tables}, ids_of)
    out = out.withColumn(ids_col, F.when(F.col(digits) == "", F.array().cast("array<int>")).otherwise(F.split(digits, " ").cast("array<int>")))
    return out if text_ids_col else out.drop(digits)


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "bytes", ranks: str | None = None) -> DataFrame:
    """``df`` with the bytes of the token ids in ``bytes_col``, one binary piece behind the other; null for null."""
    known = read_ranks(ranks or default_path("byte_bpe_50k.tiktoken"))
    pieces: list[str | None] = [None] * (max(known.values()) + 1)
    for token, rank in known.items():
        pieces[rank] = token.hex()
    table = _value(df.sparkSession, pa.table({"pieces": pa.array([pieces], pa.list_(pa.string()))}))
    # Hexadecimal pieces are joined in one pass; adding binary ones to a growing value would copy it each time.
    return _with(df, bytes_col, {"pieces": table}, lambda v: F.unhex(F.array_join(F.transform(F.col(f"`{ids_col}`"), lambda i: F.get(v["pieces"]["pieces"], i)), "")))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per row its number of tokens and the digests of its ids and of the bytes they decode to.

    A null text counts as empty: no tokens, the digests of no bytes. A null id
    stays null; repeated rows each give a row; an empty table gives an empty
    result. Only the two columns are read, so others may have any name.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = decode(encode(rows, "text", "ids", ranks, frequent=frequent, text_ids_col="digits"), "ids", "bytes", ranks)
    return rows.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.col("digits").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
