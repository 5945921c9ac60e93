"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Lower-cased texts are cut into all character n-grams of ``ORDERS``, hashed to ``BUCKETS``. Over a
seeded sample of at most about ``MAX_ROWS`` labelled texts, each bucket gets its log ratio r of
document frequencies in the two classes, smoothed in proportion to the class sizes so that an
unseen n-gram has ratio zero. A logistic regression on r times the n-gram's share of the text
is fitted to the ``KEPT`` buckets of most evidence. A score reads every n-gram of the whole text
and depends on nothing but the text.

Null and empty texts score the fitted base rate. Without labels of both classes every score is
the share of label 1, or 0 without labels, and a tie at 0.5 predicts 1. Weights are whole
multiples of 2^-16 and are summed as integers, so equal texts score equal on any layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.common import Shield, crc_fold, labelled_sample, table, text_slices, tune

ORDERS = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
KEPT = 4096
MAX_ROWS = 8_000
PRIOR = 10.0
# Least errors at the threshold by cross-validation inside the training folds (see README).
RIDGE = 1e-7
TOLERANCE = 1e-4
STEPS = 200
PART = 1 << 20
SCALE = 100.0
UNIT = 1 << 16


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray  # whole numbers of 1 / UNIT
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(BUCKETS, np.int32)
        full[self.buckets] = self.weights
        return full


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts in a row, and offsets."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    lengths = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def ngram_buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram at each position) for each order."""
    if not len(codes):
        return
    mixed = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        mixed = mixed[:-1] * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in ORDERS:
            folded = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield n, folded >> np.uint32(32 - BITS)


def _spans(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of the n-grams inside each text."""
    return offsets[:-1], np.maximum(np.diff(offsets) - n + 1, 0)


def text_features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of one text, their counts, and the number of n-grams."""
    found = [b for _, b in ngram_buckets(codes)]
    every = np.concatenate(found) if found else np.zeros(0, np.uint32)
    buckets, counts = np.unique(every, return_counts=True)
    return buckets, counts, len(every)


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int32)
    rows = [0, 0]
    for batch in text_slices(batches):
        codes, offsets = _codes(batch.column("text"))
        for label, a, b in zip(batch.column("label").to_pylist(), offsets[:-1], offsets[1:]):
            counts[label, text_features(codes[a:b])[0]] += 1
            rows[label] += 1
    if sum(rows):
        yield pa.RecordBatch.from_pydict(
            {"negatives": [rows[0]], "positives": [rows[1]], "counts": [counts.tobytes()]}
        )


def _feature_batches(kept: np.ndarray):
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            codes, offsets = _codes(batch.column("text"))
            columns: list[np.ndarray] = []
            shares: list[np.ndarray] = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                buckets, counts, total = text_features(codes[a:b])
                own = place[buckets]
                there = own >= 0
                columns.append(own[there])
                shares.append((counts[there] / max(total, 1)).astype(np.float32))
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch.column("label").cast(pa.int32()),
                    "columns": pa.array([c.tobytes() for c in columns], pa.binary()),
                    "shares": pa.array([s.tobytes() for s in shares], pa.binary()),
                }
            )

    return run


def fit_logistic(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int
) -> tuple[np.ndarray, float]:
    """Newton steps by conjugate gradients from the naive Bayes start: weight one on every feature.

    The ridge draws towards that start. The loss is convex; steps go on until the slope is
    ``TOLERANCE`` of the first one. Entries are read ``PART`` at a time.
    """
    n = len(labels)
    parts = [slice(a, a + PART) for a in range(0, len(columns), PART)]

    def forward(weights: np.ndarray) -> np.ndarray:
        own = weights[:-1]
        return sum((np.bincount(rows[p], own[columns[p]] * values[p], n) for p in parts), np.full(n, weights[-1]))

    def back(errors: np.ndarray) -> np.ndarray:
        sums = sum((np.bincount(columns[p], errors[rows[p]] * values[p], width) for p in parts), np.zeros(width))
        return np.append(sums, errors.sum()) / n

    def loss(margin: np.ndarray, weights: np.ndarray) -> float:
        return (np.logaddexp(0, margin) - labels * margin).mean() + (ridge * (weights - start) ** 2).sum() / 2

    start = np.append(np.ones(width), np.log(labels.mean() / (1 - labels.mean())))
    ridge = np.append(np.full(width, RIDGE), 0.0)
    weights, margin = start.copy(), forward(start)
    now, first = loss(margin, weights), None
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        slope = back(chance - labels) + ridge * (weights - start)
        steep = np.sqrt(slope @ slope)
        first = first or steep
        if steep <= TOLERANCE * first:
            break
        # The step solves curvature x step = -slope, the closer the nearer the end.
        spread, step, left = chance * (1 - chance), np.zeros(width + 1), -slope
        way, size = left.copy(), left @ left
        for _ in range(STEPS):
            bent = back(spread * forward(way)) + ridge * way
            part = size / max(way @ bent, 1e-300)
            step += part * way
            left -= part * bent
            before, size = size, left @ left
            if np.sqrt(size) <= min(0.25, np.sqrt(steep / first)) * steep:
                break
            way = left + size / before * way
        change, length, gain = forward(step), 1.0, slope @ step
        while (then := loss(margin + length * change, weights + length * step)) > now + 1e-4 * length * gain:
            length /= 2
            if length < 1e-8:  # rounding is all that is left to gain
                return weights[:-1], float(weights[-1])
        weights, margin, now = weights + length * step, margin + length * change, then
    return weights[:-1], float(weights[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, seed: str = "toxic") -> Model:
    """Fit on a seeded sample of labelled documents; what reaches the driver is bounded.

    That is two counts for each bucket from each task of the sample, and the kept features of
    the sampled texts.
    """
    sample = labelled_sample(labels, "toxic", train=train, seed=seed, max_rows=MAX_ROWS)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = materialize(
        texts.join(F.broadcast(sample), "doc_id").select("label", "text"), "toxicity-sample"
    )
    found = chosen.mapInArrow(
        _frequency_batches, "negatives long, positives long, counts binary"
    ).collect()
    total = sum(
        (np.frombuffer(r["counts"], np.int32).reshape(2, BUCKETS).astype(np.int64) for r in found),
        np.zeros((2, BUCKETS), np.int64),
    )
    sizes = np.array([sum(r["negatives"] for r in found), sum(r["positives"] for r in found)], float)
    if not sizes.all():
        share = sizes[1] / sizes.sum() if sizes.sum() else 0.0
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.int32), bias)
    prior = PRIOR * sizes / sizes.sum()
    ratio = np.log((total[1] + prior[1]) / (total[0] + prior[0])) - np.log(sizes[1] / sizes[0])
    evidence = np.abs(ratio) * np.sqrt(total.sum(axis=0))
    kept = np.sort(np.argsort(-evidence, kind="stable")[:KEPT])
    features = chosen.mapInArrow(
        _feature_batches(kept), "label int, columns binary, shares binary"
    ).collect()
    # The order of rows must not depend on how the sample was dealt out.
    keyed = sorted((r["columns"], r["shares"], r["label"]) for r in features)
    own = [np.frombuffer(c, np.int32) for c, _, _ in keyed]
    rows = np.repeat(np.arange(len(own), dtype=np.int32), [len(c) for c in own])
    columns = np.concatenate(own)
    shares = np.concatenate([np.frombuffer(v, np.float32) for _, v, _ in keyed])
    answers = np.array([label for *_, label in keyed], float)
    del features, keyed, own
    values = (SCALE * ratio[kept]).astype(np.float32)[columns] * shares
    weights, bias = fit_logistic(rows, columns, values, answers, len(kept))
    whole = np.rint(weights * ratio[kept] * UNIT).astype(np.int32)
    return Model(kept, whole, round(bias, 9))


def scores(texts: pa.Array, full: np.ndarray, bias: float) -> np.ndarray:
    codes, offsets = _codes(texts)
    sums = np.zeros(len(texts), np.int64)
    counts = np.zeros(len(texts), np.int64)
    for n, buckets in ngram_buckets(codes):
        running = np.concatenate([[0], np.cumsum(full[buckets], dtype=np.int64)])
        first, number = _spans(offsets, n)
        first = np.minimum(first, len(buckets))
        sums += running[first + number] - running[first]
        counts += number
    margin = bias + SCALE * sums / (np.maximum(counts, 1) * float(UNIT))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, text and score of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = model.table()
        for batch in text_slices(batches):
            score = pa.array(scores(batch.column("text"), full, model.bias), pa.float64())
            names = [n for n in batch.schema.names if n in wanted_names]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), score], [*names, "_score"])

    wanted = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("text", F.col("text").cast("string"))
    wanted_names = set(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name in keep)
    return wanted.mapInArrow(run, f"{schema}, _score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    tune(docs.sparkSession)
    shield = Shield(docs, "doc_id", "text")
    model = fit_toxicity(shield.docs, labels, train)
    scored = score_toxicity(shield.docs, model, keep=tuple(shield.inside))
    return shield.restore(scored.filter(F.col("_score") < threshold))


FOLDS = 5


def training_rows() -> Column:
    return crc_fold("doc_id", FOLDS) != 0


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, training_rows())
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_fold("doc_id", FOLDS) == 0).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
