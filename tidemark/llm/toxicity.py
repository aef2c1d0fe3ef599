"""Toxicity scores: boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BoostedTrees
from tidemark.llm.calibration import calibrated, isotonic
from tidemark.llm.frames import cut
from tidemark.llm.quality import held_out
from tidemark.session import ship

#: Labelled rows that a model is fitted on, about and at most; the sample is by a hash of the id.
SAMPLE = 20_000
#: Entries of a lexicon at most: those with the highest log-odds.
ENTRIES = 6_000
#: Words between an entry and a second person that still count as near.
NEAR = 6
#: Entries without meaning that the lexicon may hold by chance.
CHANCE = 20
FOLDS = 3
#: Letters of the word beginnings that a lexicon may list.
STEMS = (4, 5, 6, 7, 8)

#: Common insults, and second-person words of the languages at hand.
INSULTS = "idiot idiots idiotic moron moronic stupid dumb dumbass loser losers trash garbage scum scumbag pathetic worthless disgusting clown retard bastard bitch asshole jerk".split()
SECOND_PERSON = "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tus usted ustedes vosotros vuestro".split()
#: Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!|+€", "oieastasiite")
#: A character three times in a row.
THRICE = re.compile(r"(?s)(.)\1\1")

FEATURES = (
    "entry_density", "entry_weight", "heaviest", "log_entries", "distinct_entries", "insult_density",
    "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "questions", "marks",
    "obfuscated_words", "obfuscated_entries", "stretched_words", "log_words", "entries_in_first_words",
)


def entries_of(word: str) -> list[str]:
    """What a word may be listed under: itself, and its beginnings if it is longer."""
    return [word] + [f"{word[:k]}-" for k in STEMS if len(word) > k]


class Lexicon:
    """Looks words up, each once: weight, and what marks it carries."""

    REMEMBERED = 100_000

    def __init__(self, weights: dict[str, float]):
        self.weights, self.insults, self.second = weights, set(INSULTS), set(SECOND_PERSON)
        # Beginnings by their length, without the mark behind them; lengths that none is listed of are not looked up.
        stems = {k: {e[:-1]: w for e, w in weights.items() if len(e) == k + 1 and e[-1] == "-"} for k in STEMS}
        self.stems = [(k, own) for k, own in stems.items() if own]
        self._forget()

    def _forget(self) -> None:
        self.rows = np.zeros((1024, 7))
        self.number: dict[str, int] = {}

    def _weigh(self, word: str) -> float:
        """The largest weight of ``entries_of(word)``, 0 for those that are not listed."""
        weight, size = self.weights.get(word, 0.0), len(word)
        for k, own in self.stems:
            if size <= k:
                break
            w = own.get(word[:k], weight)
            if w > weight:
                weight = w
        return weight

    def _look(self, word: str) -> tuple:
        """weight, insult, second person, all capitals, obfuscated, obfuscated and listed, stretched."""
        bare = word.strip(".,;:!?\"'()[]{}*#%&$-_«»¿¡…")
        low = bare.lower()
        mixed = hidden = False
        if not bare.isalpha():
            mixed = "@" not in bare[1:-1] and not any(c in bare for c in "-'’./:") and any(map(str.isalpha, bare))
            if mixed:
                clear = "".join(c for c in low.translate(STAND_INS) if c.isalpha())
                hidden = clear in self.insults or self._weigh(clear) > 0
        thrice = THRICE.search(low)
        stretched = thrice is not None and (thrice[1].isalpha() or any(a == b == c and a.isalpha() for a, b, c in zip(low, low[1:], low[2:], strict=False)))
        return (self._weigh(low), low in self.insults, low in self.second, len(bare) > 2 and bare.isupper(), mixed, hidden, stretched)

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        words = text.split()
        n = len(words)
        if not n:
            return out
        if len(self.number) > self.REMEMBERED:
            self._forget()
        new = set(words).difference(self.number)
        if new:
            first, last = len(self.number), len(self.number) + len(new)
            if last > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(last, len(self.rows)), 7))])
            self.rows[first:last] = [self._look(w) for w in new]
            self.number.update(zip(new, range(first, last), strict=True))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, n)
        rows = self.rows[numbers]
        weight, insult, second = rows[:, 0], rows[:, 1] > 0, rows[:, 2] > 0
        hit = (weight > 0) | insult
        size = len(text)
        out[0], out[1], out[2], out[3] = hit.mean(), weight.sum() / n, weight.max(), np.log1p(hit.sum())
        out[4], out[5] = np.log1p(len(set(numbers[hit].tolist()))), insult.mean()
        if hit.any() and second.any():
            at, you = np.flatnonzero(hit), np.flatnonzero(second)
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            out[6] = (gap <= NEAR).sum() / n
        out[7] = second.mean()
        letters = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        seen = np.bincount(letters, minlength=256)
        out[8], out[9] = seen[65:91].sum() / size, rows[:, 3].mean()
        out[10], out[11] = seen[33] / size, seen[63] / size
        out[12] = (seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) / size
        out[13], out[14], out[15] = rows[:, 4].mean(), rows[:, 5].mean(), rows[:, 6].mean()
        out[16], out[17] = np.log1p(n), hit[:50].sum()
        return out


def mined(sample: DataFrame, folds: int = FOLDS) -> list[dict[str, float]]:
    """The lexicon of all of ``sample`` (text, y, fold), and those that leave one fold out each.

    Entries are counted by document on the executors; of those that three
    documents or more have, that are three times as frequent in toxic ones as
    elsewhere, and that are so beyond chance, the ``ENTRIES`` best go to the
    driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = lambda k: F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("-")))
    rows = sample.select("y", "fold", F.explode(F.array_distinct(F.concat(words, *[stems(k) for k in STEMS]))).alias("entry"))
    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    total = {y: sum(n for (_, own), n in sizes.items() if own == y) for y in (0, 1)}
    if not total[0] or not total[1]:
        return [{} for _ in range(folds + 1)]
    counts = rows.groupBy("entry").agg(
        *[F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"n{y}_{f}") for f in range(folds) for y in (0, 1)]
    )
    both = lambda y: sum((F.col(f"n{y}_{f}") for f in range(1, folds)), F.col(f"n{y}_0"))
    odds = F.log((both(1) + 0.5) / (total[1] + 1)) - F.log((both(0) + 0.5) / (total[0] + 1))
    tried = cut(counts.where(both(1) + both(0) >= 3).withColumns({"odds": odds, "have": both(1) + both(0), "share": both(1) / (both(1) + both(0))}))
    # The exponent of the chance that an entry without meaning is so often toxic; of all that are tried a few may pass by chance.
    base = total[1] / (total[0] + total[1])
    against = F.when(F.col("share") < 1, (1 - F.col("share")) * F.log((1 - F.col("share")) / (1 - base))).otherwise(0.0)
    surprise = F.col("have") * (F.col("share") * F.log(F.col("share") / base) + against)
    least = float(np.log(max(2, tried.count()) / CHANCE))
    found = tried.where((F.col("odds") > float(np.log(3))) & (surprise > least))
    best = found.orderBy((F.col("odds") * F.sqrt("have")).desc(), "entry").limit(ENTRIES).collect()

    def weigh(left_out: int | None) -> dict[str, float]:
        kept = [f for f in range(folds) if f != left_out]
        n = {y: sum(sizes.get((f, y), 0) for f in kept) for y in (0, 1)}
        out = {}
        for r in best:
            a, b = (sum(r[f"n{y}_{f}"] for f in kept) for y in (1, 0))
            w = float(np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1)))
            if a >= 2 and w > np.log(3):
                out[r["entry"]] = w
        return out

    return [weigh(None)] + [weigh(f) for f in range(folds)]


class ToxicityModel:
    """A lexicon, trees over its features, and the knots of the calibration: all of bounded size."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, knots, share: float = 0.5):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_looker"}

    def features(self, texts) -> np.ndarray:
        if not hasattr(self, "_looker"):
            self._looker = Lexicon(self.lexicon)
        return np.array([self._looker.features(t or "") for t in texts]).reshape(len(texts), len(FEATURES))

    def scores(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return calibrated(self.trees.margin(self.features(texts)), self.knots)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, out: int = 0, most: int = SAMPLE) -> ToxicityModel:
    """A model of the labelled rows that are not held out, ``most`` of them at most.

    Of more, about as many are taken by a hash of the id; only their ids are
    broadcast. Equal texts count as one, with their mean label. The texts stay on the executors; the driver gets the best
    entries and the sample's features, ``FEATURES`` numbers a row. Features
    of a fold's rows come from a lexicon mined without them, and calibration
    scores from trees grown without them.
    """
    ship(df.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    usable = usable.where(~held_out(F.col("id"), folds, out))
    # Hashes are uniform, so the bound is kept by the share of them that is taken.
    n = usable.count()
    place = F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1 << 30))
    chosen = usable.where(place < int(min(1.0, 0.97 * most / max(n, 1)) * (1 << 30))).orderBy(place, "id").limit(most)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Copies of a text teach once, with their mean label.
    known = texts.join(F.broadcast(chosen), "id").where(F.col("text").isNotNull()).withColumn("same", F.xxhash64("text"))
    sample = known.groupBy("same").agg(F.min("id").alias("id"), F.min("text").alias("text"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = cut(sample.select("id", "text", "y", F.pmod(F.col("same"), F.lit(FOLDS)).cast("int").alias("fold")).repartition(sample.sparkSession.sparkContext.defaultParallelism))
    lexica = mined(sample)
    models = sample.sparkSession.sparkContext.broadcast(lexica)

    def measure(batches):
        looks = [Lexicon(w) for w in models.value[1:]]
        for batch in batches:
            rows = batch.to_pylist()
            x = np.array([looks[r["fold"]].features(r["text"]) for r in rows]).reshape(len(rows), len(FEATURES))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), flat], ["id", "y", "fold", "x"])

    got = sample.mapInArrow(measure, "id long, y int, fold int, x array<double>").orderBy("id").toPandas()
    y = got["y"].to_numpy(float)
    if not len(got) or y.min() == y.max():
        return ToxicityModel({}, None, None, 0.5 if not len(got) else float(np.clip(y.mean(), 0.02, 0.98)))
    x, fold = np.stack(got["x"].to_numpy()), got["fold"].to_numpy()
    margins = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any() and (~own).any():
            margins[own] = BoostedTrees().fit(x[~own], y[~own]).margin(x[own])
    knots = isotonic(margins, y, np.ones(len(y)))
    return ToxicityModel(lexica[0], BoostedTrees().fit(x, y), knots)


def toxicity_scores(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """(id, score) of every row's whole text: one narrow pass with the model sent along.

    Null texts count as empty and are scored; null ids stay null; repeated
    rows each give a row, an empty table none. A model without labels of both
    kinds gives each text the share it saw, 0.5 where it saw none.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        own = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(part.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "id long, score double").toDF(id_col, score_col)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, out: int = 0) -> DataFrame:
    """Fit and score: per row its id, whether it is held out, its score and the predicted label.

    Null texts count as empty and are scored; a null id is scored and not held
    out; null labels and labels without a document don't count, and several
    labels of one id count as their mean. Repeated rows each give a row;
    without any usable label each score is 0.5; an empty table gives an empty
    result. Only the id and the text are read, so others may have any name.
    """
    scored = toxicity_scores(df, fit(df, labels, id_col, text_col, label_col, folds, out), id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col), folds, out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, all columns as they are.

    Null texts are scored as empty ones; repeated rows stay or go together; an
    empty table stays empty. A model that saw labels of one kind only, or
    none, can't tell texts apart: all rows stay.
    """
    if model.trees is None:
        return df
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def keep(batches):
        own = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                yield part.filter(pa.array(own.scores(part.column(at).to_pylist()) < threshold))

    return df.mapInArrow(keep, df.schema)
