"""Held-out recall and false alarms of op3 at its threshold, overall and per language."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factorloom.llm import toxicity
from factorloom.llm.queries import QUERIES

DOCS = "/root/testdata/sf0.1"


def test_held_out_at_the_threshold(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "lang").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DOCS}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_toxicity"](spark, DOCS).collect() if r["held_out"]]
    rows = [r for r in rows if labels.get(r["doc_id"]) in (0, 1)]
    seen = Counter((part, labels[r["doc_id"]], r["predicted"]) for r in rows for part in ("all", lang[r["doc_id"]]))
    for part in {p for p, _, _ in seen}:
        toxic = seen[part, 1, 0] + seen[part, 1, 1]
        clean = seen[part, 0, 0] + seen[part, 0, 1]
        assert seen[part, 1, 1] >= 0.75 * toxic, (part, seen)
        assert seen[part, 0, 1] <= (0.015 if part == "all" else 0.05) * clean, (part, seen)
    assert seen["all", 1, 1] >= 0.88 * (seen["all", 1, 0] + seen["all", 1, 1]), seen


def test_fit_reaches_the_least_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 700)
    draw = np.random.default_rng(1)
    full = draw.normal(size=(300, 12)) * np.logspace(-2, 0, 12)
    labels = (full @ draw.normal(size=12) + draw.normal(size=300) > 0.8).astype(float)
    rows, columns = (x.ravel().astype(np.int32) for x in np.indices(full.shape))
    weights, bias = toxicity.fit_logistic(rows, columns, full.ravel(), labels, 12)
    error = 1 / (1 + np.exp(-(full @ weights + bias))) - labels
    first = 1 / (1 + np.exp(-(full.sum(axis=1) + np.log(labels.mean() / (1 - labels.mean()))))) - labels
    slopes = [np.append(full.T @ e / 300, e.mean()) for e in (error, first)]
    slopes[0][:-1] += toxicity.RIDGE * (weights - 1)
    assert np.linalg.norm(slopes[0]) <= 1.01 * toxicity.TOLERANCE * np.linalg.norm(slopes[1])


def plain_bucket(ngram):
    """The hash of one n-gram by its definition, in whole numbers."""
    mask, mixed = (1 << 32) - 1, ord(ngram[0]) * 0x9E3779B1 & ((1 << 32) - 1)
    for char in ngram[1:]:
        mixed = (mixed * 0x85EBCA6B + ord(char) * 0xC2B2AE35) & mask
    return ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D & mask) >> (32 - toxicity.BITS)


def test_log_count_ratios_by_hand(spark, monkeypatch):
    """With every feature at weight one, the model's weights are the log-count ratios."""
    texts = ["you are bad", "YOU bad bad", "a fine day", "", "fine, fine day", None, "bad day"]
    labels = [1, 1, 0, 0, 0, 0, 1]
    monkeypatch.setattr(toxicity, "fit_logistic", lambda rows, columns, values, answers, width: (np.ones(width), 0.0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks, F.lit(True))
    counts = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels):
        low = (text or "").lower()
        counts[label].update({plain_bucket(low[i : i + n]) for n in (3, 4, 5) for i in range(len(low) - n + 1)})
    sizes = Counter(labels)
    prior = {k: toxicity.PRIOR * sizes[k] / len(labels) for k in (0, 1)}
    expected = {
        b: math.log((counts[1][b] + prior[1]) / (counts[0][b] + prior[0])) - math.log(sizes[1] / sizes[0])
        for b in {*counts[0], *counts[1]}
    }
    got = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    assert len(expected) > 50 and set(expected) <= set(got)
    assert all(got[b] == round(expected.get(b, 0.0) * toxicity.UNIT) for b in got)


def test_long_text_scores_as_its_parts_say():
    """A text of some hundred thousand letters is scored whole: its end counts as its start does."""
    full = np.zeros(toxicity.BUCKETS, np.int32)
    full[plain_bucket("zzz")] = toxicity.UNIT
    clean = "ab " * 60_000
    first, last, none = toxicity.scores(pa.array(["zzz" + clean, clean + "zzz", clean]), full, 0.0)
    assert none == 0.5 < first and abs(first - last) < 1e-9
