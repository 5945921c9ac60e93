"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text are its distinct words (lower-cased runs of letters and digits, hashed to
``WORDS`` buckets) valued by their share of the words, one indicator per structure statistic
(upper case, digits, punctuation, white space, line and word length, distinct words, immediate
repeats, repeated lines, size) and one for the size the document row states (``n_chars``, or the
text's own size where that is null).

A score is bias + linear terms + pairwise interactions through ``FACTORS`` latent factors, in
linear time: half of (square of the sum - sum of squares) for each factor. It is fitted by
AdaGrad on a seeded sample of at most about ``MAX_ROWS`` labelled texts.

Null and empty texts are texts without words. Without labels of both classes every score is the
share of label 1, or 0 without labels. A text of any length is read whole, equal texts of equal stated
size score alike on any layout, repeated rows are scored row by row, a score of just 0.5 predicts 1,
and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.common import crc_fold, labelled_sample, table, text_buffers, text_slices

WORD_BITS = 15
WORDS = 1 << WORD_BITS
BINS = 16
STATISTICS = (
    "upper", "digit", "punctuation", "space", "line_length", "word_length", "distinct", "repeats",
    "repeated_lines", "size", "stated_size",
)
WIDTH = WORDS + BINS * len(STATISTICS)
FACTORS = 8
MAX_ROWS = 12_000
EPOCHS = 12
BATCH = 256
RATE = 0.1
RIDGE = 1e-5

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_PUNCTUATION = ~(_LETTER | _DIGIT | _SPACE)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _run_hashes(raw: np.ndarray, inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of runs of ``inside`` bytes; runs stop at text edges."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    before = np.concatenate([[False], inside[:-1]])
    before[edges[edges < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[edges[(edges > 0) & (edges <= len(raw))] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    # Each run gets its own sum of byte values times powers of an odd base, by place in the run.
    last = np.zeros(len(raw), np.int64)
    last[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(last)
    value = (_LOWER[raw] + np.uint64(1)) * _power_table(int(place.max(initial=0)) + 1)[place]
    value[~inside] = 0
    hashes = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)
    return starts, ends, (hashes ^ (hashes >> np.uint64(29))) * _MIX


def _power_table(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(max(n - 1, 0), 0x5851F42D4C957F2D, np.uint64)]).astype(np.uint64))


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 or whole-number array over each text."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of a share: finer near zero."""
    share = part / np.maximum(whole, 1)
    return np.minimum(np.floor(np.sqrt(share) * BINS), BINS - 1).astype(np.int64)


def _size_bin(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(size, 0) + 1.0)), BINS - 1).astype(np.int64)


def features(texts: pa.Array, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples, sorted by text and feature, for a slice of texts."""
    raw, offsets = text_buffers(texts)
    size, n = np.diff(offsets), len(texts)
    counts = {
        name: _per_text(kind[raw], offsets)
        for name, kind in (("upper", _UPPER), ("letter", _LETTER), ("digit", _DIGIT), ("punctuation", _PUNCTUATION), ("space", _SPACE))
    }
    wordy = (_LETTER | _DIGIT)[raw]
    starts, ends, hashes = _run_hashes(raw, wordy, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(owner, minlength=n)
    letters = np.bincount(owner, ends - starts, minlength=n)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    buckets = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys, seen = np.unique(owner * WORDS + buckets, return_counts=True)
    own, bucket = keys // WORDS, keys % WORDS

    lines, line_ends, line_hashes = _run_hashes(raw, raw != 10, offsets)
    line_owner = np.searchsorted(offsets, lines, side="right") - 1
    line_count = np.bincount(line_owner, minlength=n)
    pairs = np.unique(np.stack([line_owner.astype(np.uint64), line_hashes]), axis=1) if len(lines) else np.zeros((2, 0))
    distinct_lines = np.bincount(pairs[0].astype(np.int64), minlength=n)

    bins = {
        "upper": _share_bin(counts["upper"], counts["letter"]),
        "digit": _share_bin(counts["digit"], size),
        "punctuation": _share_bin(counts["punctuation"], size),
        "space": _share_bin(counts["space"], size),
        "line_length": _size_bin(size / np.maximum(line_count, 1)),
        "word_length": np.minimum(letters / np.maximum(words, 1), BINS - 1).astype(np.int64),
        "distinct": _share_bin(np.bincount(own, minlength=n), words),
        "repeats": _share_bin(np.bincount(owner[again], minlength=n), words),
        "repeated_lines": _share_bin(line_count - distinct_lines, line_count),
        "size": _size_bin(size),
        "stated_size": _size_bin(np.where(stated >= 0, stated, size)),
    }
    marks = [WORDS + BINS * place + bins[name] for place, name in enumerate(STATISTICS)]
    text = np.concatenate([own, np.tile(np.arange(n), len(marks))])
    feature = np.concatenate([bucket, *marks])
    value = np.concatenate([seen / np.maximum(words[own], 1), np.full(n * len(marks), 0.3)])
    order = np.argsort(text * WIDTH + feature, kind="stable")
    return text[order], feature[order], value[order]


def margins(model: Model, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Bias + linear terms + pairwise terms of n texts; every text has features."""
    first = np.searchsorted(text, np.arange(n))
    linear = np.add.reduceat(model.linear[feature] * value, first)
    scaled = model.factors[feature] * value[:, None]
    sums = np.add.reduceat(scaled, first, axis=0)
    squares = np.add.reduceat(scaled * scaled, first, axis=0)
    return model.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """AdaGrad over shuffled batches of (features, values) rows."""
    random = np.random.default_rng(seed)
    share = labels.mean()
    model = Model(
        float(np.log(share / (1 - share))),
        np.zeros(WIDTH),
        random.normal(0, 0.05, (WIDTH, FACTORS)),
    )
    linear_sums, factor_sums, bias_sum = np.full(WIDTH, 1e-3), np.full((WIDTH, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            n = len(picked)
            sizes = [len(rows[i][0]) for i in picked]
            text = np.repeat(np.arange(n), sizes)
            feature = np.concatenate([rows[i][0] for i in picked])
            value = np.concatenate([rows[i][1] for i in picked]).astype(float)
            first = np.cumsum(sizes) - sizes
            scaled = model.factors[feature] * value[:, None]
            sums = np.add.reduceat(scaled, first, axis=0)
            squares = np.add.reduceat(scaled * scaled, first, axis=0)
            margin = (
                model.bias
                + np.add.reduceat(model.linear[feature] * value, first)
                + 0.5 * (sums * sums - squares).sum(axis=1)
            )
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]) / n
            own = error[text]
            touched, place = np.unique(feature, return_inverse=True)
            slope = np.bincount(place, own * value) + RIDGE * model.linear[touched]
            linear_sums[touched] += slope * slope
            model.linear[touched] -= RATE * slope / np.sqrt(linear_sums[touched])
            pull = (own * value)[:, None] * (sums[text] - scaled)
            grouped = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[grouped], np.arange(len(touched)))
            steep = np.add.reduceat(pull[grouped], starts, axis=0) + RIDGE * model.factors[touched]
            factor_sums[touched] += steep * steep
            model.factors[touched] -= RATE * steep / np.sqrt(factor_sums[touched])
            bias_slope = error.sum()
            bias_sum += bias_slope * bias_slope
            model.bias -= RATE * bias_slope / np.sqrt(bias_sum)
    return model


def _stated(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stated").fill_null(-1).to_numpy(zero_copy_only=False)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        text, feature, value = features(batch.column("text"), _stated(batch))
        cuts = np.searchsorted(text, np.arange(1, batch.num_rows))
        yield pa.RecordBatch.from_pydict(
            {
                "label": batch.column("label").cast(pa.int32()),
                "features": pa.array([f.astype(np.int32).tobytes() for f in np.split(feature, cuts)], pa.binary()),
                "values": pa.array([v.astype(np.float32).tobytes() for v in np.split(value, cuts)], pa.binary()),
            }
        )


def _inputs(docs: DataFrame, *more: str) -> DataFrame:
    stated = F.expr("try_cast(n_chars AS BIGINT)") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(*more, F.col("text").cast("string").alias("text"), stated.alias("stated"))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, seed: str = "quality") -> Model:
    """Fit on a seeded, bounded sample of labelled documents; only its features reach the driver."""
    sample = labelled_sample(labels, "quality", train=train, seed=seed, max_rows=MAX_ROWS)
    chosen = materialize(
        _inputs(docs, "doc_id").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", "stated"),
        "quality-sample",
    )
    found = (
        chosen.select("label", "text", "stated")
        .mapInArrow(_feature_batches, "label int, features binary, values binary")
        .collect()
    )
    answers = np.array([r["label"] for r in found], float)
    if not 0 < answers.sum() < len(answers):
        share = answers.mean() if len(answers) else 0.0
        return Model(30.0 if share else -30.0, np.zeros(WIDTH), np.zeros((WIDTH, FACTORS)))
    # The order of rows must not depend on how the sample was dealt out.
    keyed = sorted(
        (r["features"], r["values"], r["label"]) for r in found
    )
    rows = [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for f, v, _ in keyed]
    return fit_machine(rows, np.array([label for *_, label in keyed], float))


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            triples = features(batch.column("text"), _stated(batch))
            margin = margins(model, *triples, batch.num_rows)
            score = np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array(score, pa.float64())], [*keep, "_score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return _inputs(docs, *keep).mapInArrow(run, f"{schema}, _score double")


FOLDS, HELD_OUT = 3, 1


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_fold("doc_id", FOLDS) == HELD_OUT
    return score_quality(docs, fit_quality(docs, labels, ~held)).select(
        "doc_id",
        held.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
