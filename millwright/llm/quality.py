"""Quality rules: countable base rules, and a calibrated logistic regression over hashed n-grams.

The regression sees three families of features: word unigrams, word bigrams and runs of one to three characters.
Each family is hashed into ``BUCKETS`` buckets and a bucket's value is the square root of its share, so every text
has the same length in each family. It is fitted on a bounded sample of labelled rows; its scores become
probabilities by a logistic curve fitted on labelled rows that the weights have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.text import chunks, hashes, mix, pair, repeats_within, words

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows the weights and the calibration are fitted on, at most: those with the smallest hashes.
TRAIN_ROWS = 2400
#: Every so manieth of them calibrates.
CALIBRATE_EVERY = 4
PENALTY = 1e-4
ROUNDS = 150
#: A document is kept from this probability of good quality on.
KEEP_FROM = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_SPAN = 1 << 20

SCORED = T.StructType([
    *(T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("probability", T.DoubleType()),
])


@dataclass
class Model:
    """``weights`` per family and bucket; the probability of good quality is logistic(slope * (x . w + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logit):
        return 1 / (1 + np.exp(-np.clip(self.slope * (logit + self.bias) + self.shift, -60, 60)))


def character_runs(text: str) -> np.ndarray:
    """How often each bucket is hit by the runs of one to three characters (code points)."""
    total = np.zeros(BUCKETS, np.int64)
    drop, factor = np.uint64(64 - BUCKET_BITS), np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(text), _SPAN):
        run = np.frombuffer(text[start:start + _SPAN + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        one = run
        for order in range(3):
            fresh = one[: max(0, min(_SPAN, len(text) - start - order))]
            total += np.bincount((((fresh << np.uint64(2)) + np.uint64(order)) * factor >> drop).astype(np.int64), minlength=BUCKETS)
            one = (one[:-1] << np.uint64(20)) ^ run[order + 1:]
    return total


def _families(text: bytes, word_hashes: np.ndarray):
    """The bucket counts of the three families of one text."""
    drop = np.uint64(64 - BUCKET_BITS)
    yield np.bincount((word_hashes >> drop).astype(np.int64), minlength=BUCKETS)
    two = pair(word_hashes[:-1], word_hashes[1:])
    yield np.bincount((two >> drop).astype(np.int64), minlength=BUCKETS)
    yield character_runs(text.decode())


def _texts(batch: pa.RecordBatch, column: str):
    """(texts as bytes, word codes, first words, hash by code, code points by code) of a slice."""
    texts = batch.column(column)
    codes, starts, distinct = words(texts, lower=False)
    points = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return raw, codes, starts, mix(hashes(distinct)), points


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def repeated_words(word_hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``window`` words which the text holds twice or more."""
    n = len(word_hashes) - window + 1
    if n <= 0:
        return np.zeros(len(starts) - 1, np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = pair(word_hashes[:n], owner[:n].astype(np.uint64))
    for k in range(1, window):
        key = pair(key, word_hashes[k:k + n])
    inside = np.flatnonzero(owner[:n] == owner[window - 1:])
    hit = inside[repeats_within(key[inside])]
    cover = np.zeros(len(word_hashes) + 1, np.int64)
    cover[hit] += 1
    cover[hit + window] -= 1
    return _per_text(np.cumsum(cover[:-1]) > 0, starts)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _features(docs: DataFrame) -> DataFrame:
    """(label, mark, buckets, values): the sparse features of (text, label, mark) rows."""

    def run(batches):
        for batch in chunks(batches):
            raw, codes, starts, hashed, _ = _texts(batch, "text")
            where, what = [], []
            for k, text in enumerate(raw):
                found = list(_families(text, hashed[codes[starts[k]:starts[k + 1]]]))
                dense = np.concatenate([np.sqrt(c / max(1, c.sum())) for c in found]).astype(np.float32)
                where.append(np.flatnonzero(dense).astype(np.int32))
                what.append(dense[where[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("mark"), pa.array(where, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.float32()))],
                ["label", "mark", "buckets", "values"],
            )

    return docs.mapInArrow(run, "label double, mark long, buckets array<int>, values array<float>")


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _fit_weights(rows, where, what, y, width) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the penalised log loss; rows/where/what are the sparse entries."""
    n = len(y)
    w, v, bias, v_bias = np.zeros(width), np.zeros(width), 0.0, 0.0
    step = 1 / (0.25 * 4 + PENALTY)
    for k in range(ROUNDS):
        error = _logistic(np.bincount(rows, v[where] * what, n) + v_bias) - y
        new_w = v - step * (np.bincount(where, error[rows] * what, width) / n + PENALTY * v)
        new_bias = v_bias - step * error.mean()
        momentum = k / (k + 3)
        v, v_bias = new_w + momentum * (new_w - w), new_bias + momentum * (new_bias - bias)
        w, bias = new_w, new_bias
    return w, bias


def _fit_curve(z, y) -> tuple[float, float]:
    """Slope and shift of the logistic curve that maps scores to probabilities (targets pulled in by the class sizes)."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _logistic(slope * z + shift)
        gradient = np.array([((p - target) * z).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        change = np.linalg.solve(hessian, gradient)
        slope, shift = slope - change[0], shift - change[1]
        if np.abs(change).max() < 1e-9:
            break
    return float(slope), float(shift)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """The calibrated regression, from at most ``train_rows`` labelled rows, chosen by the hash of their id.

    Labels that are null, or of rows without a document, are left out; of contradicting labels of an id the mean
    decides, and of the rows of an id one is read. Without labels everything counts as good; with labels of one class the answer is that class's
    smoothed share, whatever the text.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).na.drop()
        .groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
        .withColumn("mark", F.xxhash64("id")).orderBy("mark", "id").limit(train_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    training = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"), F.first("mark").alias("mark"))
    found = _features(training.select("text", "label", "mark")).toArrow()
    y = found.column("label").to_numpy()
    width = 3 * BUCKETS
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 1.0
        return Model(np.zeros(width), 0.0, 1.0, float(np.log(share / (1 - share))) if share < 1 else 60.0)
    hold = found.column("mark").to_numpy() % CALIBRATE_EVERY == 0
    if len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    learning, calibrating = (_sparse(found.filter(pa.array(part))) for part in (~hold, hold))
    del found
    weights, bias = _fit_weights(*learning, y[~hold], width)
    rows, where, what = calibrating
    z = np.bincount(rows, weights[where] * what, int(hold.sum())) + bias
    slope, shift = _fit_curve(z, y[hold]) if len(set(y[hold])) == 2 else (1.0, 0.0)
    return Model(weights, bias, slope, shift)


def _sparse(found: pa.Table):
    """(row, bucket, value) of every entry."""
    counts = pc.list_value_length(found.column("buckets")).to_numpy()
    flat = (found.column(c).combine_chunks() for c in ("buckets", "values"))
    where, what = (np.concatenate([c.flatten().to_numpy() for c in getattr(x, "chunks", [x])] or [np.zeros(0, np.int32)]) for x in flat)
    return np.repeat(np.arange(len(counts), dtype=np.int32), counts), where, what


def apply_rules(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_rules", keep_from: float = KEEP_FROM) -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``out`` (see ``SCORED``).

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PERCENT`` % of them in repeated
    windows of ``WINDOW`` words. ``kept``: not failed and a probability of at least ``keep_from``. Null and blank
    texts have no words, so they fail. A column already named ``out`` is replaced. Repeated rows are all scored;
    an empty table stays empty. Whole texts are read, a few megabytes at a time.
    """
    docs = docs.drop(out)
    weights = model.weights.reshape(3, BUCKETS)

    def run(batches):
        for batch in chunks(batches, text_col):
            raw, codes, starts, hashed, points = _texts(batch, text_col)
            word_hashes = hashed[codes]
            n_words = np.diff(starts)
            repeats = repeated_words(word_hashes, starts)
            symbols, logits = np.zeros(len(raw), np.int64), np.zeros(len(raw))
            for k, text in enumerate(raw):
                symbols[k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SYMBOL
                for w, c in zip(weights, _families(text, word_hashes[starts[k]:starts[k + 1]])):
                    logits[k] += np.sqrt(c) @ w / np.sqrt(max(1, c.sum()))
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
            p = model.probability(logits)
            columns = [
                n_words, _per_text(points[codes], starts), symbols, np.array([repeated_lines(t) for t in raw], np.int64),
                repeats, failed, ~failed & (p >= keep_from), p,
            ]
            result = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=SCORED.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, SCORED)]))
