"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
import re
import time
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm_data import DOCUMENTS, letters, messy_documents

from factorloom.llm import jaccard, simhash
from factorloom.llm.common import let_go
from factorloom.llm.components import connected_components

SMALL = "/root/testdata/sf0.01"


def plain_shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    """Least row of each text's component, from all pairs."""
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for shingle in s or [()]:
            for j in holders[shingle]:
                shared[j] += 1
            holders[shingle].append(i)
        for j, n in shared.items():
            if sets[j] == s or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(sets))]


def edited(text, edits, draw):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**9)}"
    return " ".join(words)


def near_copies():
    """Copies of all distances about the threshold, one large group of them, awkward texts."""
    draw = random.Random(3)
    texts = [edited(t, n, draw) for t in (letters(s, 40 + 30 * s) for s in range(20, 32)) for n in (0, 1, 2, 4, 6, 9, 14, 20)]
    center = letters(99, 160)
    texts += [edited(center, draw.randint(1, 7), draw) for _ in range(150)]
    return texts + [t for _, t, *_ in messy_documents()]


@pytest.mark.parametrize("cell", [1024, 20])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = dict(enumerate(plain_groups(texts)))
    assert len(set(expected.values())) < len(texts)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found == expected
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_stage_on_documents(spark):
    """Some pairs here reach 0.8 at seven to nine bits, and one of 0.79 has two."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect())
    roots = plain_groups([t for _, t in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[r][0] for r in roots})


def test_empty_and_null_ids(spark):
    rows = [r for r in messy_documents() if r[0] is None] * 2
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert corpus_pipeline.near_duplicates(spark, docs, SMALL).count() == 2
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SMALL).count() == 0


def stored_classes(spark, texts, marks):
    """(texts, classes) as the stage holds them, with the given MinHash bytes."""
    sets = [jaccard.shingle_set(t.encode()) for t in texts]
    rows = [(i, jaccard._class_of(s), len(s), bytearray(m)) for i, (s, m) in enumerate(zip(sets, marks))]
    return (
        spark.createDataFrame(list(enumerate(texts)), "_row_key long, text string"),
        spark.createDataFrame(rows, "_row_key long, _class long, _size long, _marks binary"),
    )


def test_linked_fingerprints_propose_pairs_that_share_no_band(spark):
    text = letters(5, 120)
    texts = [text, edited(text, 1, random.Random(1)), letters(6, 120)]
    marks = [bytes([place]) * (jaccard.BANDS * jaccard.ROWS) for place in range(3)]
    rows, classes = stored_classes(spark, texts, marks)
    ids = [r["_class"] for r in classes.orderBy("_row_key").collect()]
    # The third class is linked, too, but its set is another.
    linked = spark.createDataFrame([(i, 7) for i in ids], "_class long, group long")
    assert jaccard.similar_classes(rows, classes, linked.limit(0)).isEmpty()
    stars = {(r["node"], r["root"]) for r in jaccard.similar_classes(rows, classes, linked.filter(f"_class != {ids[2]}")).collect()}
    assert stars == {(max(ids[:2]), min(ids[:2]))}
    found = jaccard.similar_classes(rows, classes, linked).collect()
    assert not any(ids[2] in (r["node"], r["root"]) for r in found)


def test_cells_of_linked_fingerprints_take_pairs_without_a_band():
    text = letters(7, 120)
    sets = [jaccard.shingle_set(t.encode()) for t in (text, edited(text, 1, random.Random(2)))]
    first = jaccard.signature(sets[0])
    second = first.copy()
    second[:: jaccard.ROWS] += 1
    marks, roots = np.array([first, second]), np.array([1, 2])
    none = np.zeros(2, bool)
    assert jaccard.cell_links(marks, sets, roots, none, jaccard.BANDS, False) == ([0], [1])
    assert jaccard.cell_links(marks, sets, roots, none, 0, False) == ([], [])


def test_stage_links_the_fingerprints_of_all_texts(spark, monkeypatch):
    seen, linked = [], simhash.linked_fingerprints
    monkeypatch.setattr(simhash, "linked_fingerprints", lambda v: seen.append(v) or linked(v))
    texts = [letters(s, 40) for s in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts, ""])), "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, SMALL).count() == 7
    expected = {simhash.fingerprint(t.encode()) for t in texts}
    assert {r["fp"] % (1 << 64) for r in seen[0].collect()} == expected


def kept_shuffles(spark):
    """Exchanges whose files Spark still keeps, after those that are free have gone."""
    statuses = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    last = -1
    for _ in range(20):
        time.sleep(0.5)
        if (now := statuses.size()) == last:
            break
        last = now
    return last


def test_finished_plans_leave_no_exchanges(spark, monkeypatch):
    kept = []

    def counted(edges):
        kept.append(kept_shuffles(spark))
        return connected_components(edges)

    monkeypatch.setattr(jaccard, "connected_components", counted)
    text = letters(7, 60)
    docs = spark.createDataFrame([(i, f"{text} {letters(100 + i % 3, 4)}") for i in range(9)], "doc_id long, text string")
    let_go(spark)
    before = kept_shuffles(spark)
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {0}
    # The plan that ended last may still be held by Spark's listeners.
    assert kept[0] - before <= 1
