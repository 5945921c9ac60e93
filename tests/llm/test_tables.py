"""Operators over whole tables: classifiers, mixing, top-k, repeats, near-duplicates, pipeline."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from llm_data import DOCUMENTS, messy_documents
from pyspark.sql import functions as F

from factorloom.llm import components, mixing, quality, repeats, simhash, topk, toxicity
from factorloom.llm.common import Shield
from factorloom.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")

SMALL = "/root/testdata/sf0.01"


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sql_rows(name, folder):
    connection = duckdb.connect()
    for table in os.listdir(folder):
        table = table.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    return columns, result.fetchall()


# --- classifiers -----------------------------------------------------------------------------


def area_under_curve(scores, labels):
    positive, negative = scores[labels == 1], np.sort(scores[labels == 0])
    below = np.searchsorted(negative, positive, side="left") + np.searchsorted(negative, positive, side="right")
    return below.mean() / 2 / len(negative)


@pytest.mark.parametrize(
    "name, label, folds, held, least", [("op3_toxicity", "toxic", 5, 0, 0.75), ("op8_quality", "quality", 3, 1, 0.9)]
)
def test_held_out_ranking(spark, name, label, folds, held, least):
    found = QUERIES[name](spark, SMALL)
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    test = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    scores = np.array([r["score"] for r in test])
    assert area_under_curve(scores, np.array([labels[r["doc_id"]] for r in test])) > least


@pytest.mark.parametrize("name", ["op3_toxicity", "op8_quality"])
def test_equal_texts_score_alike_on_any_layout(spark, write, name):
    docs = [r for r in messy_documents()] + [(100 + i, r[1], "zz", "q", r[4], *r[5:]) for i, r in enumerate(messy_documents())]
    labels = [(i, i % 2, i % 2) for i in range(11)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (6, 7, 7)]
    folder = write(documents=(docs, DOCUMENTS), labels=(labels, "doc_id long, quality int, toxic int"))
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == len(docs)
    text_of = defaultdict(set)
    for i, t, *_ in docs:
        text_of[i].add(t)
    scores = defaultdict(set)
    for r in rows:
        if len(text_of[r["doc_id"]]) == 1:
            scores[next(iter(text_of[r["doc_id"]]))].add(r["score"])
    assert all(len(s) == 1 for s in scores.values())
    again = {r["doc_id"]: r["score"] for r in QUERIES[name](spark, folder).collect() if r["doc_id"]}
    assert again == {r["doc_id"]: r["score"] for r in rows if r["doc_id"]}


@pytest.mark.parametrize("name", ["op3_toxicity", "op8_quality"])
def test_classifiers_without_labels(spark, write, no_documents, name):
    schema = "doc_id long, quality int, toxic int"
    folder = write(documents=(messy_documents(), DOCUMENTS), labels=([], schema))
    rows = QUERIES[name](spark, folder).collect()
    assert {r["predicted"] for r in rows} == {0} and len(rows) == len(messy_documents())
    folder = write(documents=(messy_documents(), DOCUMENTS), labels=([(i, 1, 1) for i in range(9)], schema))
    assert {r["predicted"] for r in QUERIES[name](spark, folder).collect()} == {1}
    assert QUERIES[name](spark, no_documents).count() == 0


def test_ngram_scores_by_hand():
    import pyarrow as pa

    full = np.arange(toxicity.BUCKETS, dtype=np.int32)
    texts = ["", "ab", "Abc", "abcdefgé" * 3, None]
    found = toxicity.scores(pa.array(texts), full, 0.25)
    for text, score in zip(texts, found):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        buckets, counts, total = toxicity.text_features(codes)
        margin = 0.25 + toxicity.SCALE * int((full[buckets].astype(object) * counts).sum()) / (max(total, 1) * toxicity.UNIT)
        assert math.isclose(score, 1 / (1 + math.exp(-max(-30, min(30, margin)))), rel_tol=1e-12)


def test_machine_margin_by_pairs():
    draw = np.random.default_rng(0)
    model = quality.Model(0.3, draw.normal(size=quality.WIDTH), draw.normal(size=(quality.WIDTH, quality.FACTORS)))
    features = np.array([3, 9, 40, 5, 9])
    values = np.array([0.5, 1.0, 2.0, 1.0, 3.0])
    text = np.array([0, 0, 0, 1, 1])
    found = quality.margins(model, text, features, values, 2)
    for t in range(2):
        own = [(f, v) for f, v, x in zip(features, values, text) if x == t]
        total = model.bias + sum(model.linear[f] * v for f, v in own)
        total += sum(
            model.factors[f] @ model.factors[g] * v * w for i, (f, v) in enumerate(own) for g, w in own[i + 1 :]
        )
        assert math.isclose(found[t], total)


# --- mixing ----------------------------------------------------------------------------------


def plain_targets(sizes, weights, share, epochs):
    """Water-filling by hand: clamp, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in clamped]
        level = (left - sum(clamped.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > epochs * sizes[s]]
        if not above:
            return {s: clamped.get(s, weight[s] * level) for s in order}
        clamped |= {s: epochs * sizes[s] for s in above}


def test_op5(spark, messy, no_documents):
    found = QUERIES["op5_mixing"](spark, messy)
    columns, expected = sql_rows("op5_mixing", messy)
    assert found.columns == columns and by_value(found.collect()) == by_value(expected)
    sizes, source_of = defaultdict(int), defaultdict(set)
    for i, t, _, s, *_ in messy_documents():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source_of[i].add(s)
    targets = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = defaultdict(int)
    for r in found.collect():
        if len(source_of[r["doc_id"]]) > 1:
            continue
        source = next(iter(source_of[r["doc_id"]]))
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], targets[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - targets[s]) < 3 for s in ("b", "ü", ""))
    assert QUERIES["op5_mixing"](spark, no_documents).count() == 0


def test_mix_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    plan = QUERIES["op5_mixing"](spark, SMALL)
    target = plan.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target"), F.max("size"))
    words = mixed.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n"))
    for row in target.join(words, "source").collect():
        assert abs(row["n"] - row[1]) <= row[2]


def test_hot_source_is_cut_by_digits(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("a b c").alias("text")
    ).unionAll(spark.createDataFrame([(-1, "cold", "a " * 300_000)], "doc_id long, source string, text string"))
    sized = mixing.sized(rows)
    plan = mixing.apply_mix(sized.select("doc_id", "source", "_size", "_key"), *mixing.plan_mix(sized))
    hot = plan.filter("source = 'hot'").agg(F.sum("_taken"), F.first("_target")).first()
    assert abs(hot[0] - hot[1]) <= 1


# --- top-k -----------------------------------------------------------------------------------


def test_op6(spark, write, no_documents):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8)], 0) for i in range(120)]
    rows += [(200 + i, [0.5] * 8, 0) for i in range(60)]
    rows += [(300, None, None), (301, [0.1, None, *[0.0] * 6], 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] * 8, 1)]
    rows += [(400, [1.0, 2.0], 1), (401, [2.0, 1.0], 1), (None, [0.5] * 8, 1), (20, rows[20][1], 5), (420, [], 1)]
    folder = write(embeddings=(rows, "vec_id long, embedding array<float>, label int"), documents=([], DOCUMENTS))
    found = QUERIES["op6_topk"](spark, folder)
    columns, expected = sql_rows("op6_topk", folder)
    assert sorted(found.columns) == sorted(columns)
    assert by_value(found.select(*columns).collect()) == by_value(expected)
    assert QUERIES["op6_topk"](spark, no_documents).count() == 0


@pytest.mark.parametrize("scale", [3, 40, 100_000])
def test_block_bounds_and_result(scale):
    draw = np.random.default_rng(scale)
    candidates = draw.integers(-scale, scale + 1, (700, 16)) * (draw.random((700, 16)) < 0.3)
    candidates[:40] *= 3
    queries = candidates[::9]
    ids = draw.permutation(700)
    found = topk.nra_block(ids[::9], queries, ids, candidates, 20)
    got = defaultdict(list)
    for q, v, s in zip(*found):
        got[q].append((-s, v))
    for q, vector in zip(ids[::9], queries):
        every = sorted((-int(vector @ c), i) for c, i in zip(candidates, ids) if i != q)
        assert got[q] == every[:20]
    lists = topk.SortedLists(candidates, np.float64)
    lower, upper = lists.bounds(queries.astype(float), 100)
    exact = queries @ candidates.T
    assert (lower <= exact).all() and (exact <= upper).all()


# --- repeats ---------------------------------------------------------------------------------


def plain_removal(texts, length):
    counts = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                covered[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_op7(spark, messy, no_documents):
    docs = messy_documents()
    expected = plain_removal([(t or "").encode() for _, t, *_ in docs], 400)
    found = QUERIES["op7_repeats"](spark, messy).collect()
    assert by_value(found) == by_value((d[0], *e) for d, e in zip(docs, expected))
    assert sum(e[1] for e in expected) > 4000
    assert QUERIES["op7_repeats"](spark, no_documents).count() == 0


def test_repeats_with_many_edges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    draw = np.random.default_rng(8)
    base = [bytes(draw.choice(np.frombuffer(b"abcd ", np.uint8), 600)) for _ in range(6)]
    texts = []
    for i in range(60):
        text = bytearray(base[i % 6])
        for _ in range(draw.integers(0, 4)):
            text[draw.integers(0, 600)] = 122
        cut = draw.integers(0, 200)
        texts.append((b"ab" * int(draw.integers(0, 90)) + bytes(text[cut : cut + draw.integers(50, 500)])).decode())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = repeats.remove_repeats(docs, length=60, reach=24, block=8).collect()
    expected = plain_removal([t.encode() for t in texts], 60)
    for r in found:
        n, removed, runs, kept = expected[r["doc_id"]]
        assert r["n_bytes"] == n and sum(x["end"] - x["start"] for x in r["runs"]) == removed
        assert len(r["runs"]) == runs and hashlib.sha256(r["kept"]).hexdigest() == kept


# --- near-duplicates -------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_op10(spark, messy, no_documents):
    docs = messy_documents()
    prints = [plain_fingerprint(t) for _, t, *_ in docs]
    roots = plain_components(prints)
    least = defaultdict(list)
    for (i, *_), root in zip(docs, roots):
        if i is not None:
            least[root].append(i)
    expected = [
        (d[0], f"{p:016x}", min(least[r]) if least[r] else None) for d, p, r in zip(docs, prints, roots)
    ]
    assert by_value(QUERIES["op10_simhash"](spark, messy).collect()) == by_value(expected)
    assert QUERIES["op10_simhash"](spark, no_documents).count() == 0


@pytest.mark.parametrize("limit", [4096, 60])
def test_dense_fingerprints(spark, limit):
    draw = np.random.default_rng(1)
    values = set(map(int, draw.integers(0, 1 << 63, 400, dtype=np.uint64)))
    for center in draw.integers(0, 1 << 63, 3, dtype=np.uint64):
        for _ in range(150):
            flips = draw.choice(64, draw.integers(0, 8), replace=False)
            values.add(int(center) ^ sum(1 << int(b) for b in flips))
    order = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in order]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.link_fingerprints(frame, 4, limit).collect()
    place = {v: i for i, v in enumerate(signed)}
    a, b = ([place[r[c]] for r in links] for c in ("a", "b"))
    joined = simhash._forest(np.array(a, np.int64), np.array(b, np.int64), len(order))
    plain = np.array(plain_components(order))
    assert len(set(zip(joined, plain))) == len(set(joined)) == len(set(plain))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, 2000 + i) for i in range(30)]
    frame = spark.createDataFrame([*path, *star, (7, 7), (9, 8)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected_components(frame).collect()}
    assert found == {**{i + 1: 1000 for i in range(1000, 1060)}, **{2000 + i: 5 for i in range(30)}, 9: 8}


def test_one_of_each_group_stays(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = messy_documents()
    roots = plain_components([plain_fingerprint(t) for _, t, *_ in rows])
    expected = {}
    for row, root in zip(rows, roots):
        key = (row[0] is None, row[0])
        if root not in expected or key < expected[root][0]:
            expected[root] = (key, row[0])
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(i) for _, i in expected.values())


# --- pipeline --------------------------------------------------------------------------------


def test_shield_keeps_clashing_names(spark):
    frame = spark.createDataFrame([(1, "t", "a", "b")], ["doc_id", "text", "_kept_2", "x.y"])
    shield = Shield(frame, "doc_id", "text")
    assert shield.restore(shield.docs).collect()[0] == (1, "t", "a", "b")
    assert shield.restore(shield.docs).columns == frame.columns


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against what it should do to its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        if name != "tokens":
            assert out.columns == columns
        if name == "toxicity":
            model_rows = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, SMALL).collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, s in model_rows.items() if s < 0.5}
        if name == "near_duplicates":
            groups = simhash.near_duplicates(docs)
            firsts = {r[0] for r in groups.select("component_id").distinct().collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == firsts and out.count() == len(firsts)
        if name == "personal_data":
            assert out.count() == docs.count()
            assert out.filter(F.col("text").rlike(r"@[a-z0-9-]+\.[a-z]")).count() == 0
        if name == "mixing":
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
        if name == "tokens":
            assert out.count() == docs.count()
            sums = Counter(r[0] for r in docs.select(F.sha2("text", 256)).collect())
            assert sums == Counter(r["decoded_sha256"] for r in out.collect())
        docs = out
    assert 0 < docs.count() and before > 0


def test_pipeline_on_awkward_rows(spark, write, no_documents):
    labels = ([(i, 1, i % 2) for i in range(11)], "doc_id long, quality int, toxic int")
    folder = write(documents=(messy_documents(), DOCUMENTS), labels=labels)
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, no_documents).count() == 0
