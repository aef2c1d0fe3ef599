"""Quality scores: random Fourier features, ridge by partition sums, isotonic calibration."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.calibration import calibrated, isotonic
from tidemark.llm.frames import cut
from tidemark.session import ship

STATISTICS = (
    "log_bytes", "log_words", "letters", "capitals", "digits", "spaces", "line_ends", "beyond_ascii",
    "stops", "commas", "exclamations", "bars", "symbols", "brackets", "other_marks",
    "mean_word", "spread_word", "longest_word", "distinct_words", "same_as_last", "capital_words",
    "symbol_ends", "lone_marks", "distinct_lines", "words_a_line", "most_common_byte", "packed_share",
)

#: Fixed sets of ASCII characters that the statistics count.
_SETS = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t", "line_ends": b"\n\r",
    "stops": b".?", "commas": b",;:", "exclamations": b"!", "bars": b"|", "symbols": b"#$%&*+=@^_~\\/<>", "brackets": b"()[]{}", "other_marks": b"'\"`-",
}
_SYMBOLS = list(_SETS).index("symbols")
_MASK = np.zeros((256, len(_SETS)))
for _k, _chars in enumerate(_SETS.values()):
    _MASK[list(_chars), _k] = 1


def statistics(raw: bytes) -> np.ndarray:
    """The statistics of one text's bytes; zeros where a text has nothing to count."""
    out = np.zeros(len(STATISTICS))
    size = len(raw)
    if not size:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    share = seen @ _MASK / size
    out[0], out[1] = np.log1p(size), np.log1p(n)
    out[2:7], out[7], out[8:15] = share[:5], seen[128:].sum() / size, share[5:]
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        out[15], out[16], out[17] = lengths.mean(), lengths.std(), np.log1p(lengths.max())
        out[18] = len(set(words)) / n
        out[19] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[20] = sum(map(bytes.isupper, words)) / n
        ends = np.fromiter((w[-1] for w in words), np.int64, n)
        out[21] = _MASK[ends, _SYMBOLS].mean()
        out[22] = (lengths == 1).mean() - np.fromiter(map(bytes.isalnum, words), bool, n)[lengths == 1].sum() / n
    lines = raw.split(b"\n")
    out[23], out[24] = len(set(lines)) / len(lines), np.log1p(n / len(lines))
    out[25] = seen.max() / size
    out[26] = len(zlib.compress(raw, 1)) / size
    return out


def _features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def measure(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary())
            rows = np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), len(STATISTICS))
            x = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, "id long, x array<double>")


class FourierMap:
    """Cosines of random projections, whose products approximate a Gaussian kernel of the standardised statistics."""

    def __init__(self, mean, spread, width: int, bandwidth: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean), np.asarray(spread)
        self.w = rng.normal(size=(len(self.mean), width)) / bandwidth
        self.b = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones((len(x), 1))])


def _summed(rows: DataFrame, expand, bands: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: one matrix from each partition, in bands that are added up on the executors."""

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            z = expand(x)
            part = z.T @ np.hstack([z, y[:, None]])
            total = part if total is None else total + part
        if total is not None:
            parts = np.array_split(total, bands)
            yield pa.RecordBatch.from_arrays([pa.array(range(bands), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["band", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"band": pdf["band"].iloc[:1], "sums": [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]})

    parts = rows.select("x", "y").mapInArrow(partial, "band int, sums binary")
    # In two steps, so that one task never adds up the parts of more than some hundred others.
    spread = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = spread.groupBy("band", "lane").applyInPandas(add, "band int, sums binary")
    found = {r["band"]: np.frombuffer(bytes(r["sums"])) for r in first.groupBy("band").applyInPandas(add, "band int, sums binary").collect()}
    if not found:
        return np.empty((0, 0)), np.empty(0)
    flat = np.concatenate([found[k] for k in range(bands)])
    width = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)  # flat holds width * (width + 1) numbers
    both = flat.reshape(width, width + 1)
    return both[:, :-1], both[:, -1]


def held_out(id_col: Column, folds: int, out: int) -> Column:
    """Whether crc32 of the id, written as text, leaves ``out``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))


BINS = 2048
#: Rows that a calibration needs.
LEAST = 30


def fit(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, usable: Column, width: int = 192, bandwidth: float = 6.0, ridge: float = 1e-3, seed: int = 5):
    """The scoring function (matrix of statistics to scores), learnt from all usable labelled rows.

    A tenth of these, by a hash of the id, is left for the calibration; if it
    holds fewer than ``LEAST`` rows, or labels of one kind, there is none. The
    driver sees sums, one matrix and ``BINS`` counts, whatever the number of rows.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    rows = cut(features.join(y.where(usable), "id").withColumn("late", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10)) == 0))
    moments = rows.where(~F.col("late")).agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(len(STATISTICS))],
        *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(len(STATISTICS))],
    ).first()
    n = moments["n"]
    if not n:
        share = rows.agg(F.avg("y")).first()[0]
        return lambda x: np.full(len(x), 0.5 if share is None else share)
    mean = np.array([moments[f"m{k}"] for k in range(len(STATISTICS))])
    spread = np.maximum(np.array([moments[f"s{k}"] for k in range(len(STATISTICS))]), 1e-3)
    expand = FourierMap(mean, spread, width, bandwidth, seed)
    gram, moment = _summed(rows.where(~F.col("late")), expand)
    beta = np.linalg.solve(gram + ridge * n * np.eye(len(gram)), moment)

    def raw(x: np.ndarray) -> np.ndarray:
        return np.clip(expand(x) @ beta, -1, 2)

    def bins(batches):
        total = np.zeros((BINS, 2))
        for batch in batches:
            if batch.num_rows:
                at = np.clip(((raw(np.stack(batch.column(0).to_numpy(zero_copy_only=False))) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
                np.add.at(total, at, np.stack([np.ones(len(at)), batch.column(1).to_numpy(zero_copy_only=False)], axis=1))
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used, 0]), pa.array(total[used, 1])], ["bin", "n", "y"])

    counted = rows.where("late").select("x", "y").mapInArrow(bins, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()
    if counted["n"].sum() < LEAST or counted["y"].sum() in (0, counted["n"].sum()):
        return lambda x: np.clip(raw(x), 0.0, 1.0)  # too few to calibrate on; the regression's own scores
    knots = isotonic((counted["bin"].to_numpy() + 0.5) / BINS * 3 - 1, counted["y"].to_numpy(), counted["n"].to_numpy())
    return lambda x: calibrated(raw(x), knots)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, out: int = 1) -> DataFrame:
    """Per row of ``df`` its id, whether it is held out, its score and the predicted label.

    Statistics of whole texts are taken in one narrow pass and kept in the
    shared folder; labels are joined to them by id, texts are not shuffled.
    Rows are held out where crc32 of the id modulo ``folds`` is ``out``:
    their labels are never read into a fit. A score depends on the text
    alone. A null text counts as empty and is scored; a null id is scored and
    not held out; null labels and labels without a document don't count, and
    several labels of one id count as their mean. Repeated rows each give a
    row; without any usable label each score is 0.5; an empty table gives an
    empty result.
    """
    features = cut(_features(df, id_col, text_col))
    score_of = fit(features, labels, id_col, label_col, ~held_out(F.col("id"), folds, out))

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                s = score_of(np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["id", "score"])

    scored = features.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
