"""A quality classifier: Naive Bayes support vectors over n-gram indicators.

A text is the set of its byte trigrams and of runs of eight words written as fresh or repeated
(a word is repeated if it stood among the eight words before it), hashed into BUCKETS
indicators. Each indicator is scaled by the log ratio of its smoothed class frequencies, the
vector is brought to length one, and a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve turns margins into scores between 0 and 1.

The model is fitted on a bounded sample: labelled rows whose id digest falls below a
threshold that leaves about `max_rows` of them (a fifth of which fits the logistic curve). The
sample's ids are bounded, so they are broadcast and documents are filtered where they lie;
only the sample's indicator sets come to the driver. All documents are then scored in one
pass, without a shuffle. Labels, language, source and id are no inputs of a score.

Defined results: a null text counts as empty; an empty text has no indicator and gets the
score of a margin equal to the bias; rows without a label are not learned from, rows without
an id neither, nor are they held out; of several labels of one id the lowest counts; repeated
rows get the same score; without labels of both classes every score is the share of label 1
(0.5 without any label); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.near_dup import word_hashes
from gridsight.llm.registry import fresh, query, read, slices, with_texts

BUCKETS = 1 << 17
#: Labelled rows to fit on, a documented bound.
MAX_ROWS = 12_000
#: Bytes of text whose indicators are made at once.
CHUNK = 500_000
RUN = 8
COST = 1.0
EPOCHS = 12
FOLDS = 4
HELD_OUT = 2
ACCEPT = 0.7


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct indicator numbers of each UTF-8 text, ascending."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    grams = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
             >> np.uint32(15)) if len(data) > 2 else np.empty(0, np.uint32)
    words, sizes = word_hashes(texts)
    repeated = np.zeros(len(words), bool)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for lag in range(1, RUN + 1):
        repeated[lag:] |= (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])
    runs = np.zeros(max(0, len(words) - RUN + 1), np.uint32)
    for k in range(RUN):
        runs = runs << 1 | repeated[k:k + len(runs)]
    # Runs take the numbers after those of trigrams, which use 17 bits.
    runs = (runs + np.uint32(BUCKETS)).astype(np.uint32)
    out, at, word = [], 0, 0
    seen = np.zeros(BUCKETS + (1 << RUN), bool)
    for text, size in zip(texts, sizes.tolist()):
        mine = grams[at:at + max(0, len(text) - 2)]
        its_runs = runs[word:word + max(0, size - RUN + 1)]
        if len(mine) < 20_000:
            found = np.unique(np.concatenate([mine, its_runs]))
        else:
            seen[:] = False
            seen[mine] = True
            seen[its_runs] = True
            found = np.flatnonzero(seen)
        out.append(found.astype(np.int32))
        at += len(text)
        word += size
    return out


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = mean of weights + bias."""
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        length = np.sqrt(float(r @ r))
        return float(r @ self.weights[found]) / length + self.bias if length else self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, size: int) -> np.ndarray:
    """log of (smoothed share of an indicator in class 1 / in class 0)."""
    counts = np.ones((2, size))
    for found, label in zip(rows, good):
        counts[int(label), found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, size: int,
            cost: np.ndarray, epochs: int = EPOCHS, seed: int = 42) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise |w|^2 / 2 + sum cost * hinge, by dual coordinate descent.

    The bias is the weight of a constant input of 1.
    """
    weights, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            found, v = rows[i], values[i]
            slack = sign[i] * (float(weights[found] @ v) + bias) - 1
            new = min(max(dual[i] - slack / square[i], 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weights[found] += step * v
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to the label, by Newton steps."""
    # Smoothed targets, so that a clean split keeps a finite slope.
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.zeros(2)

    def loss(p: np.ndarray) -> float:
        z = x @ p
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-6 * float(p @ p)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - target) + 2e-6 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        scale = 1.0
        while scale > 1e-6 and loss(at - scale * step) > loss(at):
            scale /= 2
        at = at - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model of labelled indicator sets; every fifth row fits the curve only."""
    size = BUCKETS + (1 << RUN)
    nothing = Model(np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0)
    if not len(rows) or good.all() or not good.any():
        share = float(good.mean()) if len(rows) else 0.5
        nothing.shift = 500.0 if share == 1 else -500.0 if share == 0 else 0.0
        return nothing
    aside = np.arange(len(rows)) % 5 == 4
    if good[aside].all() or not good[aside].any() or good[~aside].all() or not good[~aside].any():
        aside = np.zeros(len(rows), bool)
    learn = np.flatnonzero(~aside)
    ratios = log_count_ratios([rows[i] for i in learn], good[learn], size)

    def scaled(found: np.ndarray) -> np.ndarray:
        v = ratios[found]
        length = np.sqrt(float(v @ v))
        return v / length if length else v

    sign = np.where(good[learn], 1.0, -1.0)
    # Both classes weigh the same.
    share = good[learn].mean()
    cost = COST * np.where(good[learn], 0.5 / share, 0.5 / (1 - share))
    weights, bias = descend([rows[i] for i in learn], [scaled(rows[i]) for i in learn], sign, size, cost)
    model = Model(ratios, weights, bias, 1.0, 0.0)
    against = np.flatnonzero(aside) if aside.any() else learn
    model.slope, model.shift = curve(np.array([model.margin(rows[i]) for i in against]), good[against])
    return model


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in pc.fill_null(texts, "").cast(pa.binary()):
        text = text.as_py()
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str,
           text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicator sets and labels of about `max_rows` labelled documents outside the fold
    held out, one for each id, in the order of their ids' digests."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()
                         & (fold(F.col(id_col)) != HELD_OUT)).select(
        F.col(id_col).alias("_id"), F.col(label).alias("_label"), F.xxhash64(id_col).alias("_digest"))
    n = known.count()
    if n > max_rows:
        # A digest is uniform over the longs.
        known = known.where(F.col("_digest") < int(-2 ** 63 + 2 ** 64 * (max_rows / n)))
    chosen = known.groupBy("_id", "_digest").agg(F.min("_label").alias("_label"))
    mine = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_of") == F.col("_id"))
    # One row for each id, that of the smallest text digest, however many carry the id.
    mine = mine.groupBy("_id", "_digest", "_label").agg(
        F.min_by("_text", F.sha2(F.coalesce("_text", F.lit("")), 256)).alias("_text"))
    mine = mine.select("_digest", "_label", "_text").repartition(32, "_digest")
    schema = T.StructType([T.StructField("_digest", T.LongType()), T.StructField("_good", T.BooleanType()),
                           T.StructField("_found", T.BinaryType())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for part in _parts(batch.column(2)) for x in indicators(part)]
            good = pc.equal(batch.column(1), pa.scalar(1, batch.column(1).type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), good, pa.array(found, pa.binary())], [f.name for f in schema])

    rows = sorted(mine.mapInArrow(collect, schema).collect())
    return ([np.frombuffer(r["_found"], np.int32) for r in rows],
            np.array([r["_good"] for r in rows], bool))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(*sample(docs, labels, label, max_rows, id_col, text_col))


def score(docs: DataFrame, model: Model, text_col: str = "text",
          keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """The columns `keep` and `into`, the score, of every row."""
    # A few MB, whatever the corpus holds.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(into, T.DoubleType())])
    n = len(keep)
    sent, place = with_texts(docs, keep, text_col, "_judged")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches):
            found = [fitted.score(x) for part in _parts(batch.column(place)) for x in indicators(part)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(found, pa.float64())], schema.names)

    return sent.mapInArrow(judge, schema)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without the rows whose score is under ACCEPT."""
    names = tuple(docs.columns)
    value = fresh(list(names), "_score")
    return score(docs, train(docs, labels, **options), keep=names, into=value).where(
        F.col(value) >= ACCEPT).select(*names)


@query("op2_quality_model")
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
