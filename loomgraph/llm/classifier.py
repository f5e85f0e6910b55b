"""Quality classifier: naive Bayes support vectors.

Texts become indicators of n-grams: of words (one and two), of character shapes (runs of
lower-case, capitals, digits, each symbol; one to four), and of how much of the text
repeats its own three-word grams or doubles its words.  Indicators are scaled by their class log-count ratio,
counted over every labelled training row, and a linear hinge-loss model is fitted by dual
coordinate descent on at most ``MAX_TRAIN`` of those rows (the ones of least hash, as many as have
``MAX_BYTES`` of features together).  Margins become probabilities by a logistic fit on a fifth of
the sample that the model doesn't see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.sieve import maybe_in
from loomgraph.llm.wordhash import buffers, distinct, shingles, words
from loomgraph.plans.store import materialize, ship_package

MAX_TRAIN = 8_000
MAX_BYTES = 128 << 20  # of the sample's features, 2 bytes each, on the driver
FOLDS = 5
THRESHOLD = 0.3
BITS = 16
SIZE = 1 << BITS
SHAPES, REPEATS, DOUBLES = 1 << 14, 32, 16  # features 0..SHAPES are shapes, the last tell repetition and doubled words
EPOCHS, COST, SMOOTH = 15, 1.0, 1.0
PIECE = 1 << 20

#: Byte to shape: 1 lower-case or not ASCII, 2 capital, 3 digit, 4 blank, 5 line break, others their own.
_SHAPE = np.ones(256, np.uint32)
_SHAPE[:128] = np.arange(6, 134) % 60 + 6
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58] = 1, 2, 3
_SHAPE[[32, 9, 11, 12, 13]], _SHAPE[10] = 4, 5


def _shape_features(b: np.ndarray, mark: np.ndarray) -> None:
    """Mark the 1- to 4-grams of the text's runs of shapes."""
    for a in range(0, len(b), PIECE):  # pieces overlap, so that no gram is cut unless its runs are huge
        c = _SHAPE[b[max(0, a - 64) : a + PIECE]]
        c = c[np.concatenate(([True], c[1:] != c[:-1]))]
        code = np.zeros(len(c), np.uint32)
        for order in range(1, 5):
            if len(c) < order:
                break
            code = code[: len(c) - order + 1] * np.uint32(67) + c[order - 1 :]
            mark[((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - 14)] = True


def _mark_share(mark: np.ndarray, first: int, steps: int, share: float) -> None:
    mark[first : first + int(share * (steps - 1)) + (share > 0)] = True


def features(column: pa.Array):
    """Yield the distinct feature numbers of each text, in order."""
    data, at = buffers(column)
    mark = np.zeros(SIZE, bool)
    span = np.uint64(SIZE - SHAPES - REPEATS - DOUBLES)
    for first, h, starts in words(column):
        for j in range(len(starts) - 1):
            i, w = first + j, h[starts[j] : starts[j + 1]]
            _shape_features(data[at[i] : at[i + 1]], mark)
            mark[SHAPES + ((w >> np.uint64(16)) % span).astype(np.int64)] = True
            if len(w) > 1:
                mark[SHAPES + ((shingles(w, 2) >> np.uint64(16)) % span).astype(np.int64)] = True
            grams = shingles(w, 3)
            repeated = 1 - len(distinct(grams)) / max(1, len(grams))
            _mark_share(mark, SIZE - REPEATS, REPEATS, repeated)
            _mark_share(mark, SIZE - REPEATS - DOUBLES, DOUBLES, np.count_nonzero(w[1:] == w[:-1]) / max(1, len(w) - 1))
            out = np.flatnonzero(mark)
            mark[out] = False
            yield out


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return float(scaled(x, self.ratio) @ self.weight[x] + self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _count(batches):
    """Texts of each class that hold each feature: (feature, good, bad), summed over the task."""
    sums = np.zeros((2, SIZE), np.int64)
    for batch in batches:
        label = batch.column(1).to_pylist()
        for y, x in zip(label, features(batch.column(0))):
            sums[y][x] += 1
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[1][at]), pa.array(sums[0][at])], ["feature", "good", "bad"])


def _extract(batches):
    for batch in batches:
        got = [x.astype(np.uint16).tobytes() for x in features(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], ["doc_id", "label", "x"])


def scaled(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The values of a text's features: their ratios, as a vector of length 1."""
    r = ratio[x]
    return r / max(1e-9, np.sqrt(r @ r))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: (weights, bias) over the rows' features, scaled by ``ratio``.

    Values are made anew for each step, so memory is that of the features alone.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    share = {s: max(1, int((y == s).sum())) for s in (1, -1)}
    most = np.array([cost * min(4.0, len(rows) / (2 * share[int(s)])) for s in y])  # classes weigh alike, within reason
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            x = rows[i]
            v = scaled(x, ratio)
            step = alpha[i] - (y[i] * (w[x] @ v + bias) - 1) / (v @ v + 1)
            new = min(max(step, 0.0), most[i])
            if (change := (new - alpha[i]) * y[i]) != 0:
                w[x] += change * v
                bias += change
                alpha[i] = new
    return w, bias


def log_count_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Of each feature, from the number of good and bad texts that hold it."""
    p, q = good + SMOOTH, bad + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | margin), by Newton steps with smoothed targets (Platt)."""
    good, bad = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, np.log((good + 1) / (bad + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -60, 60)))
        g = np.array([(p - t) @ m, (p - t).sum()])
        v = p * (1 - p)
        hess = np.array([[v @ (m * m) + 1e-6, v @ m], [v @ m, v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> Model:
    """Learn from the rows of ``labels`` that aren't held out; null ids and labels are left out.

    An id that is labelled twice has its least label; of texts that share an id all are counted,
    and the sample takes the one of least features.  Without any labelled text, or with one class
    only, the model knows nothing but the classes' shares.
    """
    ship_package(docs.sparkSession)
    train = labels.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    train = train.groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Only rows that may be labelled are shuffled to their label.
    near = texts.where(maybe_in(F.col("doc_id"), train.select(F.col("doc_id").alias("key")))).join(train, "doc_id")
    counts = near.select("text", "label").mapInArrow(_count, "feature long, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    at, good, bad = counts.column("feature").to_numpy(), np.zeros(SIZE), np.zeros(SIZE)
    good[at], bad[at] = counts.column("good").to_numpy(), counts.column("bad").to_numpy()
    ratio = log_count_ratio(good, bad)
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").mapInArrow(_extract, "doc_id long, label int, x binary")
    found = materialize(found.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("e")).select("doc_id", "e.label", "e.x"), "sample")
    load = F.sum(F.octet_length("x")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample alone
    picked = found.withColumn("load", load).where(F.col("load") <= MAX_BYTES).select("doc_id", "label", "x").toArrow()
    order = np.argsort(picked.column("doc_id").to_numpy(), kind="stable")
    rows = [np.frombuffer(picked.column("x")[int(i)].as_buffer(), np.uint16) for i in order]
    y = picked.column("label").to_numpy()[order] * 2.0 - 1
    if len(set(y.tolist())) < 2:
        return Model(ratio, np.zeros(SIZE), 0.0, 1.0, float(np.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1))))
    test = np.arange(len(rows)) % 5 == 4
    part = [i for i in range(len(rows)) if not test[i]]
    w, b = descend([rows[i] for i in part], y[part], ratio)
    m = np.array([w[rows[i]] @ scaled(rows[i], ratio) + b for i in np.flatnonzero(test)])
    slope, shift = _logistic(m, y[test])
    return Model(ratio, w, b, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row; null text is scored as empty."""

    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            m = np.array([model.margin(x) for x in features(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(m), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
