"""Packed series, one ranking for all sections, bounded top-K, gates in joins, publication, stopping."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from panel_data import rows, weekdays
from pyspark.sql import functions as F

from factorloom.functions import ranking
from factorloom.functions.columns import ContractError, seeded_draw
from factorloom.operators import metrics as mt
from factorloom.operators import quality as q
from factorloom.operators import sampling as sm
from factorloom.operators import universe as un
from factorloom.operators import windows as wn
from factorloom.operators.features import feature_panel
from factorloom.operators.indexes import sample_metadata
from factorloom.operators.scoring import best_round, fit_tree_baseline, prediction_frame, score_table
from factorloom.operators.splits import SplitDates
from factorloom.plans.stage import derive_bars
from factorloom.sources import snapshot as sn
from factorloom.sources.tables import StandardTables

# --- packed series ---------------------------------------------------------------------------


def grid(spark, lengths):
    data = []
    for name, length in lengths.items():
        for i, day in enumerate(weekdays(length)):
            x = None if i % 5 == 3 else float(i)
            data.append((name, day, x, -float(i), i % 4 != 1))
    columns = "security_id string, trade_date date, x double, y double, observed_y boolean"
    return spark.createDataFrame(data, columns).repartition(3)


def every_window(lengths, context):
    data = []
    for name, length in lengths.items():
        days = weekdays(length)
        data += [(f"{name}|{i}", name, days[i], days[i - context + 1]) for i in range(context - 1, length)]
    return data


@pytest.mark.parametrize("context, chunk", [(1, 1), (4, 3), (4, 7), (5, None), (13, 12)])
def test_windows_out_of_chunks(spark, context, chunk):
    lengths = {"a": 40, "b": 13, "c": 12, "d": 4, "e": 1}
    features = grid(spark, lengths)
    index = spark.createDataFrame(
        every_window(lengths, context), "sample_id string, security_id string, asof_date date, feature_start date"
    )
    packed = wn.pack_series(features, context_length=context, channels=["x", "y"], chunk_length=chunk)
    size = chunk or 4 * context
    found = {(r["security_id"], r["chunk"]): r for r in packed.collect()}
    assert set(found) == {(n, k) for n, length in lengths.items() for k in range(-(-length // size))}
    for (name, k), row in found.items():
        start, stop = max(0, k * size - context + 1), min(lengths[name], (k + 1) * size)
        assert row["dates"] == weekdays(lengths[name])[start:stop] and row["home"] == k * size - start
    cut = wn.cut_windows(packed, index, context_length=context).collect()
    assert len(cut) == index.count()
    for row in cut:
        end = int(row["sample_id"].split("|")[1])
        steps = range(end - context + 1, end + 1)
        assert [v[0] for v in row["values"]] == [0.0 if i % 5 == 3 else float(i) for i in steps]
        assert [m[0] for m in row["observed_mask"]] == [i % 5 != 3 for i in steps]
        assert [m[1] for m in row["observed_mask"]] == [i % 4 != 1 for i in steps]
    with pytest.raises(ValueError):
        wn.pack_series(features, context_length=9, channels=["x"], chunk_length=5)


def test_a_window_that_is_not_there_stops(spark):
    lengths = {"a": 9}
    features, days = grid(spark, lengths), weekdays(9)
    columns = "sample_id string, security_id string, asof_date date, feature_start date, split string"
    for bad in (("a|x", "a", days[2], days[0], "train"), ("b|1", "b", days[5], days[2], "train"),
                ("a|z", "a", dt.date(2030, 1, 1), days[0], "train"), ("a|n", "a", days[5], None, "train")):
        index = spark.createDataFrame([bad, ("a|5", "a", days[5], days[2], "test")], columns)
        assert wn.context_windows(features, index, channels=["x"], context_length=4, split="test").count() == 1
        with pytest.raises(Exception, match="window bounds disagree"):
            wn.context_windows(features, index, channels=["x"], context_length=4).collect()


# --- sections --------------------------------------------------------------------------------


def scored(spark, seed=0, dates=9, names=37):
    draw = np.random.default_rng(seed)
    table = pd.DataFrame(
        [(d, f"s{i}") for d in weekdays(dates, dt.date(2023, 12, 20)) for i in range(names)],
        columns=["asof_date", "security_id"],
    )
    n = len(table)
    table["score_raw"] = np.round(draw.normal(size=n), 1)
    table.loc[draw.random(n) < 0.4, "score_raw"] = 0.5
    table["score_neutralized"] = np.where(draw.random(n) < 0.3, np.nan, draw.normal(size=n))
    table["target"] = np.round(draw.normal(size=n), 2)
    table["industry_code"] = draw.choice(["x", "y", "", "z"], n)
    table.loc[draw.random(n) < 0.1, "industry_code"] = None
    table["log_float_market_cap"] = np.where(draw.random(n) < 0.1, np.nan, np.round(draw.normal(size=n), 1))
    schema = (
        "asof_date date, security_id string, score_raw double, score_neutralized double, target double, "
        "industry_code string, log_float_market_cap double"
    )
    values = [tuple(None if v != v else v for v in row) for row in table.itertuples(index=False)]
    return table, spark.createDataFrame(values, schema).repartition(6)


def test_sections_against_pandas(spark):
    table, frame = scored(spark)
    sections = [
        mt.Section("raw", "score_raw"),
        mt.Section("neutralized", "score_neutralized"),
        mt.Section("industry", "score_raw", "industry_code"),
    ]
    found = mt.ranked_sections(frame, sections).toPandas().set_index(["section", "part", "asof_date", "security_id"])
    total = 0
    for section in sections:
        own = table[table[section.score].notna()].copy()
        own["part"] = "" if section.part is None else own[section.part]
        own = own[own["part"].notna()].sort_values([section.score, "security_id"])
        groups = own.groupby(["part", "asof_date"])
        own["position"] = groups.cumcount() + 1
        own["n"] = groups["target"].transform("size")
        own["score_rank"], own["target_rank"] = groups[section.score].rank(), groups["target"].rank()
        total += len(own)
        for row in own.itertuples():
            got = found.loc[(section.name, row.part, row.asof_date, row.security_id)]
            assert (got.position, got.n) == (row.position, row.n)
            assert (got.score_rank, got.target_rank) == (row.score_rank, row.target_rank)
            assert (got.score, got.target) == (getattr(row, section.score), row.target)
    assert len(found) == total


def same_rows(left, right, by):
    left, right = (f.toPandas().sort_values(by).reset_index(drop=True) for f in (left, right))
    pd.testing.assert_frame_equal(left[sorted(left)], right[sorted(right)], check_dtype=False, rtol=1e-9)


def test_one_ranking_gives_what_each_grouping_gives(spark):
    _, frame = scored(spark, 1)
    tables = mt.evaluate_predictions(frame)
    same_rows(tables["by_year"], mt.stability_by_year(frame), "year")
    same_rows(tables["by_industry"], mt.stability_by_industry(frame), "industry_code")
    same_rows(tables["by_size"], mt.stability_by_size(frame), "size_bucket")
    for name, score in (("raw", "score_raw"), ("neutralized", "score_neutralized")):
        own = F.col("score") == name
        same_rows(tables["daily_ic"].filter(own).drop("score"), mt.daily_ic(frame, score), "asof_date")
        book = tables["daily_portfolio"].filter(own).drop("score")
        same_rows(book, mt.daily_portfolio(frame, score), "asof_date")


def test_evaluation_without_neutral_scores_caps_or_rows(spark):
    _, frame = scored(spark, 2, dates=2, names=3)
    bare = frame.withColumns(
        {c: F.lit(None).cast("double") for c in ("score_neutralized", "log_float_market_cap")}
    )
    tables = mt.evaluate_predictions(bare)
    assert {r["score"] for r in tables["daily_ic"].collect()} == {"raw"} and tables["by_size"].isEmpty()
    assert mt.evaluate_predictions(frame.limit(0))["daily_portfolio"].isEmpty()


# --- top K, draws ----------------------------------------------------------------------------


def test_bounded_top_k(spark):
    draw = np.random.default_rng(3)
    data = [
        (f"s{i}", day, float(draw.integers(0, 9)) if draw.random() < 0.9 else None, bool(draw.random() < 0.8))
        for day in weekdays(6) for i in range(40)
    ]
    frame = spark.createDataFrame(data, "security_id string, trade_date date, adv20_usd double, eligible_candidate boolean")
    every = {(r[0], r[1]): (r["liquidity_rank"], r["eligible"]) for r in un.daily_liquidity_topk(frame, 7).collect()}
    first = un.daily_liquidity_topk(frame, 7, rank_all=False)
    for day in weekdays(6):
        own = sorted((d for d in data if d[1] == day and d[3]), key=lambda d: (d[2] is None, -(d[2] or 0), d[0]))
        for rank, (name, *_) in enumerate(own, 1):
            assert every[name, day] == (rank, rank <= 7)
    assert len(every) == len(data)
    for r in first.collect():
        rank, eligible = every[r["security_id"], r["trade_date"]]
        assert (r["liquidity_rank"], r["eligible"]) == (rank if eligible else None, eligible)
    plan = first._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_draws_are_md5_of_seed_and_values(spark):
    frame = spark.createDataFrame([("a", 3), ("b", None)], "k string, v int")
    got = [r[0] for r in frame.select(seeded_draw("7:1", "k", "v")).collect()]
    assert got == [hashlib.md5(t.encode()).hexdigest() for t in ("7:1|a|3", "7:1|b")]


def test_batches_follow_the_draw(spark):
    ids = [f"k{i}" for i in range(25)]
    index = spark.createDataFrame([(i, weekdays(3)[n % 3], i) for n, i in enumerate(ids)],
                                  "sample_id string, asof_date date, security_id string")
    plan = {r["sample_id"]: r["batch_id"] for r in sm.sequence_batches(index, batch_size=4, seed=9, epoch=2).collect()}
    order = sorted(ids, key=lambda i: hashlib.md5(f"9:2|{i}".encode()).hexdigest())
    assert [plan[i] for i in order] == [n // 4 for n in range(25)]


# --- gates in joins --------------------------------------------------------------------------


def test_joins_stop_on_repeated_keys(spark, panel):
    bars, universe, days = panel
    assert feature_panel(bars, universe).count() == universe.count()
    for one, two in ((bars.unionByName(bars.limit(1)), universe), (bars, universe.unionByName(universe.limit(1)))):
        with pytest.raises(Exception, match="repeats a key"):
            feature_panel(one, two).collect()
    index = universe.select(F.col("symbol").alias("sample_id"), "security_id", "symbol",
                            F.col("trade_date").alias("asof_date"), F.lit("train").alias("split"))
    assert sample_metadata(index, universe).count() == universe.count()
    with pytest.raises(Exception, match="universe repeats a key"):
        sample_metadata(index, universe.unionByName(universe.limit(1))).collect()


@pytest.mark.parametrize("validate, left, right, fits", [
    ("1:1", [1, 2], [2, 3], True), ("1:1", [1, 1], [1], False), ("1:1", [1], [1, 1], False),
    ("m:1", [1, 1, 2], [1, 2], True), ("m:1", [2], [1, 1], False), ("1:m", [1, 2], [1, 1], True),
    ("1:m", [1, 1], [3], False),
])
def test_checked_join(spark, validate, left, right, fits):
    one = spark.createDataFrame([(k, f"l{i}") for i, k in enumerate(left)], "k int, l string")
    two = spark.createDataFrame([(k, f"r{i}") for i, k in enumerate(right)], "k int, r string")
    joined = q.checked_join(one, two, ["k"], validate)
    if fits:
        assert rows(joined, "k", "l", "r") == rows(one.join(two, "k"), "k", "l", "r")
        q.assert_join_cardinality(one, two, ["k"], validate)
    else:
        with pytest.raises(Exception, match="repeats a key"):
            joined.collect()
        with pytest.raises(ContractError):
            q.assert_join_cardinality(one, two, ["k"], validate)


def test_predictions_stop_on_two_scores(spark, panel):
    universe, days = panel[1], panel[2]
    index = universe.select(F.concat_ws("|", "security_id", "trade_date").alias("sample_id"), "security_id", "symbol",
                            F.col("trade_date").alias("asof_date"), F.lit("valid").alias("split"), F.lit(0.5).alias("target"))
    metadata = sample_metadata(index, universe)
    scores = index.select("sample_id", F.lit(1.0).alias("score_raw"))
    ids = {"model_id": "m", "checkpoint_hash": "h", "dataset_id": "d"}
    assert prediction_frame(index, metadata, scores, **ids).count() == index.count()
    with pytest.raises(Exception, match="scores repeats a key"):
        prediction_frame(index, metadata, scores.unionByName(scores.limit(1)), **ids).collect()
    with pytest.raises(Exception, match="metadata repeats a key"):
        prediction_frame(index, metadata.unionByName(metadata.limit(1)), scores, **ids).collect()


# --- publication -----------------------------------------------------------------------------


def test_two_writers_of_one_snapshot(spark, panel, tmp_path, monkeypatch):
    """A second writer starts and ends inside the first: neither replaces what the other reads."""
    bars, universe, days = panel
    config = sn.DatasetConfig("test", SplitDates(days[39], days[59], days[79], 3), context_length=30)
    tables, root, inner = StandardTables(bars, universe), str(tmp_path), {}
    real = sn.bundle_audit

    def audit(found):
        if not inner:
            inner["running"] = True
            inner["folder"], inner["manifest"] = sn.write_snapshot(tables, config, root)
            inner["frames"] = sn.read_snapshot(spark, inner["folder"])[1]
            inner["before"] = {n: f.count() for n, f in inner["frames"].items()}
        return real(found)

    monkeypatch.setattr(sn, "bundle_audit", audit)
    folder, manifest = sn.write_snapshot(tables, config, root)
    assert folder == inner["folder"] and manifest == inner["manifest"]
    assert {n: f.count() for n, f in inner["frames"].items()} == inner["before"]
    attempts = {p.name for p in (tmp_path / folder.rsplit("/", 1)[1]).iterdir()}
    assert manifest["attempt"] in attempts and len(attempts - {sn.MANIFESTS}) == 2


def test_both_publish_and_the_first_counts(spark, tmp_path):
    folder = str(tmp_path / "x")
    assert sn.published_manifest(spark, folder) is None
    for attempt, time in (("b", "2024-01-02"), ("c", "2024-01-01"), ("a", "2024-01-01")):
        sn.write_json(spark, {"attempt": attempt, "created_at": time}, f"{folder}/{sn.MANIFESTS}", mode="append")
    assert sn.published_manifest(spark, folder)["attempt"] == "a"


# --- stopping --------------------------------------------------------------------------------


def test_best_round_by_patience():
    assert best_round([5, 4, 3, 3.5, 3.2, 2.9], 3) == (6, False)
    assert best_round([5, 4, 3, 3.5, 3.2, 3.1, 1], 3) == (3, True)
    assert best_round([1, 2, 3], 2) == (1, True) and best_round([2.0], 1) == (1, False)


def test_boosting_stops_at_its_best_round(spark):
    draw = np.random.default_rng(2)
    data = []
    for i in range(300):
        x = draw.normal(size=4)
        split = "train_fit" if i < 160 else "inner_selection" if i < 240 else "valid"
        data.append((f"k{i}", split, float(x[0] + 1.5 * draw.normal()), x.tolist()))
    table = spark.createDataFrame(data, "sample_id string, split string, target double, vector array<float>").coalesce(2)
    most, patience = 300, 8
    model = fit_tree_baseline(table, seed=3, rounds=most, patience=patience, learning_rate=0.2)
    kept = len(model.trees)
    assert kept < most
    longer = fit_tree_baseline(table.filter("split = 'train_fit'"), seed=3, rounds=kept + patience, learning_rate=0.2)
    assert len(longer.trees) == kept + patience
    selection = table.filter("split = 'inner_selection'")

    def error(m):
        gap = score_table(m, selection).join(selection, "sample_id").select((F.col("target") - F.col("score_raw")) ** 2)
        return np.mean([r[0] for r in gap.collect()])

    assert error(model) <= error(longer)
    stump = fit_tree_baseline(table.filter("split = 'train_fit'"), seed=3, rounds=kept, learning_rate=0.2)
    assert rows(score_table(stump, table), "sample_id") == rows(score_table(model, table), "sample_id")


# --- ties across sort partitions, bars without a sort before their exchange ----------------------


def test_ties_that_cross_sort_partitions_share_their_rank(spark):
    values = [(g, f"s{i:03d}", None if i % 11 == 0 else float(i % 3) * (g != "flat")) for g in ("a", "b", "flat") for i in range(120)]
    values.append(("c", "s000", float("nan")))
    frame = spark.createDataFrame(values, "g string, security_id string, value double")
    # Every partition of the table cuts a run of ties.
    ordered = frame.repartitionByRange(7, "g", "value", "security_id").sortWithinPartitions("g", "value", "security_id")
    stored = ranking.stamped(ordered, "test-ties")
    assert stored.select("__part").distinct().count() > 4
    placed = ranking.tie_ranked(stored, "position", "rank", "value", ["g"], size="n")
    data = pd.DataFrame(values, columns=["g", "security_id", "value"])
    key = data.value.fillna(1e9).where(~data.value.isna() | (data.g == "c"), -1e9)
    data["expected"] = key.groupby(data.g).rank(method="average")
    expected = {(r.g, r.security_id): r.expected for r in data.itertuples()}
    found = {(r["g"], r["security_id"]): (r["rank"], r["n"]) for r in placed.collect()}
    assert found == {k: (v, 1 if k[0] == "c" else 120) for k, v in expected.items()}
    for g in ("a", "b", "flat"):
        assert sorted(r["position"] for r in placed.filter(F.col("g") == g).collect()) == list(range(1, 121))


def test_ranked_sections_exchange_rows_twice_only(spark):
    """Once by partition and group, once by security; before also by value, on both sides of a join."""
    data = [(dt.date(2020, 1, 1), f"s{i}", float(i % 4), float(i)) for i in range(20)]
    frame = spark.createDataFrame(data, "asof_date date, security_id string, score_raw double, target double")
    ranked = mt.ranked_sections(frame, [mt.Section("all", "score_raw")])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert ranked.filter("n != 20").isEmpty() and ranked.count() == 20


def test_bars_are_exchanged_before_they_are_grouped(spark):
    lines = spark.createDataFrame(
        [(k, dt.datetime(1998, 1, d), o, 1, 1, float(d), 10.0 * d * k, 0.1) for k in (1, 2) for d in (3, 5) for o in (1, 2)],
        "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long,"
        " l_quantity double, l_extendedprice double, l_discount double",
    )
    bars = derive_bars(lines)
    plan = bars._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("REPARTITION_BY_COL" if "REPARTITION_BY_COL" in plan else "RepartitionByExpression") :]
    assert "Aggregate" not in below
    found = sorted((r["security_id"], r["open"], r["close"], r["volume"]) for r in bars.collect())
    assert found == [("sec:1", 10.0, 10.0, 16.0), ("sec:2", 20.0, 20.0, 16.0)]


def test_ranks_are_exact_when_places_are_cut(spark, monkeypatch):
    """Ties, NULLs and one-valued dates over many parts; before, no group was numbered in parts."""
    monkeypatch.setattr(ranking, "PART_ROWS", 8)
    monkeypatch.setattr(ranking, "CUT_SAMPLE", 2)
    day, flat = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    data = [(day, f"s{i:03}", float(i * 7 % 23), None if i % 4 == 0 else float(i % 3)) for i in range(300)]
    data += [(flat, f"s{i:03}", 0.5, float("nan") if i % 5 == 0 else 1.0) for i in range(300)]
    frame = spark.createDataFrame(data, "asof_date date, security_id string, score_raw double, target double")
    members = frame.withColumnRenamed("score_raw", "score")
    _, _, starts = ranking.cut_places(members, ["asof_date"], ["score", "target"])
    assert starts.groupBy("__place", "measure").count().filter("count > 5").count() == 4
    found = mt.ranked_sections(frame, [mt.Section("all", "score_raw")]).collect()
    assert len(found) == 600
    table = pd.DataFrame(data, columns=["day", "key", "score", "target"]).sort_values(["day", "score", "key"])
    order = [-1e9 if row[3] is None else 1e9 if row[3] != row[3] else row[3] for row in data]
    table["order"] = pd.Series(order).reindex(table.index)
    groups = table.groupby("day")
    table["position"], table["score_rank"] = groups.cumcount() + 1, groups["score"].rank()
    table["target_rank"] = groups["order"].rank()
    expected = {(r.day, r.key): (r.position, 300, r.score_rank, r.target_rank) for r in table.itertuples()}
    assert {
        (r["asof_date"], r["security_id"]): (r["position"], r["n"], r["score_rank"], r["target_rank"]) for r in found
    } == expected
