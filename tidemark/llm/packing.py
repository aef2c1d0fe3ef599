"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.merging import encoder_of
from tidemark.llm.vocab import default_path, read_json_bpe
from tidemark.session import ship


class CapacityTree:
    """A tournament over bins in the order of their opening: each node holds the larger room of its two children.

    The leftmost bin with enough room is found on one way down from the root.
    """

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the room it had."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        at = node
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return node - self.leaves, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Per size the bin it goes to and its offset there; larger sizes first, equal ones as given."""
    tree = CapacityTree(len(sizes), capacity)
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        where[k], had = tree.put(sizes[k])
        offset[k] = capacity - had
    return where, offset


def pieces_of(df: DataFrame, capacity: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """Per document its ids, with ``end_id`` behind them, cut into full sequences and a rest."""
    import public_tokenizers

    ship(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(read_json_bpe(vocabulary or default_path("byte_bpe_50k.json")))
    pattern, end = public_tokenizers.PATTERN, np.array([end_id], "<u4")

    def cut(batches):
        encoder = encoder_of(spec.value, pattern)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, own in zip(ids, encoder.id_arrays(batch.column(1).to_pylist()), strict=True):
                own = np.append(own, end)
                for start in range(0, len(own), capacity):
                    part = own[start : start + capacity]
                    for column, value in zip(rows, (doc_id, start, len(part), zlib.crc32(part), len(own)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.mapInArrow(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long")


#: A piece's columns, and equal ones that are numbered at a time.
PIECE, BLOCK = ["id", "start", "length", "ids_crc32", "doc_tokens"], 4096


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``copy``, which numbers equal ones from 0.

    They are counted, which combines before the shuffle, and counts are
    unfolded block by block: no array grows with the number of copies.
    """
    counted = pieces.groupBy(*PIECE).agg(F.count("*").alias("n"))
    blocks = counted.withColumn("first", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK)))).withColumn("first", F.col("first") * BLOCK)
    return blocks.select(*PIECE, F.explode(F.sequence("first", F.least(F.col("first") + BLOCK, "n") - 1)).alias("copy"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, group_size: int = 4096, vocabulary: str | None = None, seed: int = 17) -> DataFrame:
    """Pieces of all documents, placed gaplessly into sequences of ``capacity`` ids.

    Pieces are dealt into groups, one for each ``group_size`` documents, by a
    seeded hash of id, place, content and the number among equal ones, and
    each group is packed by itself, first-fit decreasing; so a group is of
    about one size whatever the table's, and the same rows are packed the
    same way however they are split, also by a lost task that runs again. What is dealt are the pieces' numbers,
    never ids or texts. A sequence belongs to one group: its id holds the
    group and the bin.

    A null text is an empty document, that is one piece with the end id
    alone. Null ids and repeated rows are documents of their own; equal pieces
    of one group are packed in any order, which makes no difference. An empty table
    gives no pieces.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, -(-df.count() // group_size))
    # Equal pieces, of rows with one id, are numbered, so that they are not one group, and so that no file or partition has a say.
    dealt = numbered(pieces_of(rows, capacity, end_id, vocabulary)).withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), *PIECE, "copy"), F.lit(groups))).drop("copy")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "start", "ids_crc32", "length"], kind="stable", ignore_index=True)
        bins, offset = first_fit_decreasing(pdf["length"].tolist(), capacity)
        group = int(pdf["pack_group"].iloc[0])
        out = pdf[["id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = np.asarray(bins, np.int64) + (group << 32)
        out["offset"] = np.asarray(offset, np.int64)
        return out

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(place, schema).withColumnRenamed("id", id_col)
