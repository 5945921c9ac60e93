"""Contracts fail closed, identities hold NULLs apart, winners do not depend on order."""

import datetime as dt

import pytest
from panel_data import BAR_COLUMNS, UNIVERSE_COLUMNS, bar_rows, universe_rows, weekdays
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, ContractError
from factorloom.operators import quality as q
from factorloom.operators.features import apply_robust_scaler, build_features
from factorloom.operators.labels import build_labels
from factorloom.operators.metrics import compare_runs
from factorloom.operators.splits import (
    SplitDates,
    inner_selection_split,
    walk_forward_datasets,
    walk_forward_scalers,
)
from factorloom.operators.universe import attach_observations, build_universe
from factorloom.sources import payloads
from factorloom.sources.snapshot import content_hash

PREDICTIONS = (
    "run_id string, security_id string, symbol string, asof_date date, score_raw double, "
    "score_neutralized double, target double, split string, model_id string, checkpoint_hash string, "
    "dataset_id string, eligible boolean, industry_code string, log_float_market_cap double"
)


def run_rows(run, dataset="d", split="valid", names="abc", model="m", shift=0.0):
    day = dt.date(2024, 1, 1)
    return [
        (run, n, n, day, float(i), None, i + shift, split, model, "h", dataset, True, "x", 1.0)
        for i, n in enumerate(names)
    ]


def test_content_hash_keeps_null_places_apart(spark):
    schema = "low double, open double"
    moved = [spark.createDataFrame([row], schema) for row in ((5.0, None), (None, 5.0), (5.0, 5.0))]
    assert len({content_hash(frame) for frame in moved}) == 3
    rows = [(1.0, None), (None, 2.0)]
    assert content_hash(spark.createDataFrame(rows, schema)) == content_hash(
        spark.createDataFrame(rows[::-1], schema).repartition(3)
    )


def test_true_counts_of_models_and_datasets(spark):
    rows = run_rows("r", model="m1") + run_rows("r", model="m2", dataset="e") + run_rows("r", model="m3")
    frame = spark.createDataFrame(rows, PREDICTIONS)
    found = q.prediction_report(frame).first()
    assert (found["models"], found["datasets"]) == (3, 2)
    empty = frame.filter("false")
    found = q.prediction_report(empty).first()
    assert (found["models"], found["datasets"]) == (0, 0)
    for broken in (frame, empty):
        with pytest.raises(ContractError):
            q.require_predictions(broken)
    one = spark.createDataFrame(run_rows("r"), PREDICTIONS)
    assert q.require_predictions(one) is one


def test_a_key_twice_in_one_run_is_a_difference(spark):
    rows = run_rows("a") + run_rows("a", names="a") + run_rows("b")[1:]
    found = q.same_samples(spark.createDataFrame(rows, PREDICTIONS)).collect()
    assert [(r["security_id"], r["runs"], r["rows"]) for r in found] == [("a", 1, 2)]


@pytest.mark.parametrize(
    "other", [{"dataset": "e"}, {"split": "test"}, {"names": "ab"}, {"names": "abcc"}, {"shift": 1.0}]
)
def test_unlike_runs_are_not_compared(spark, other):
    expected = spark.createDataFrame([("d", 3), ("e", 3)], "dataset_id string, expected_rows long")
    same = spark.createDataFrame(run_rows("a") + run_rows("b"), PREDICTIONS)
    assert compare_runs(same, expected).count() == 2
    with pytest.raises(ContractError):
        compare_runs(spark.createDataFrame(run_rows("a") + run_rows("b", **other), PREDICTIONS), expected)


def test_cells_of_a_fold_hold_the_same_samples(spark):
    schema = "fold_id string, seed long, model_key string, security_id string, asof_date date, target double"
    day = dt.date(2024, 1, 1)
    full = [("f", s, m, k, day, 1.0) for s in (1, 2) for m in ("x", "y") for k in "ab"]
    assert q.unequal_cells(spark.createDataFrame(full, schema)).isEmpty()
    for broken in (full[1:], [*full, full[0]], [*full[1:], (*full[0][:5], 2.0)]):
        assert not q.unequal_cells(spark.createDataFrame(broken, schema)).isEmpty()


def test_winners_do_not_depend_on_order(spark):
    schema = "Code string, Name string, Exchange string, Currency string, Type string, Isin string, IsDelisted boolean, precedence int, place int"
    rows = [
        ("X", "first", "NYSE", "USD", "Common Stock", "i", True, 1, 1),
        ("X", "last", "NYSE", "USD", "Common Stock", "i", True, 1, 2),
        ("X", "active", "NYSE", "USD", "Common Stock", "i", False, 1, 9),
    ]
    names, placed = set(), set()
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        frame = spark.createDataFrame(order, schema).coalesce(1)
        names.add(payloads.build_metadata_index(frame, "US").first()["name"])
        args = {"exchange_code": "US", "exchanges": ["NYSE"], "security_types": ["common_stock"]}
        split = (frame.filter("NOT IsDelisted"), frame.filter("IsDelisted"))
        placed.add(payloads.discover_candidates(*split, **args, position="place").first()["Name"])
    assert len(names) == 1 and placed == {"last"}


def test_built_tables_keep_their_contracts(spark):
    days = weekdays(30)
    bars = spark.createDataFrame(bar_rows("a", days), BAR_COLUMNS)
    universe = spark.createDataFrame(universe_rows("a", days), UNIVERSE_COLUMNS)
    for broken in ((bars.unionAll(bars.limit(1)), universe), (bars, universe.unionAll(universe.limit(1)))):
        with pytest.raises(ContractError):
            build_labels(*broken)
    part = bars.filter(F.col("trade_date") > days[10])
    assert payloads.union_batches([bars.filter(F.col("trade_date") <= days[10]), part], "bars").count() == 30
    with pytest.raises(ContractError):
        payloads.union_batches([bars, part], "bars")
    source = bars.withColumns(
        {
            "is_delisted_source": F.lit(False),
            "exchange_source": F.lit("NYSE"),
            "security_type_source": F.lit("Common Stock"),
            "identity_quality": F.lit("isin"),
            "provider_symbol": F.lit("A.US"),
        }
    )
    rules = {"min_listed_sessions": 5, "min_price": 1.0, "min_adv20_usd": 1.0}
    assert build_universe(source, **rules).count() == 30
    with pytest.raises(ContractError):
        build_universe(source.withColumn("symbol", F.lit(None).cast("string")), **rules)


def test_symbol_is_carried_without_a_forward_frame(spark):
    days = weekdays(4)
    grid = spark.createDataFrame([("a", d, "late") for d in days], "security_id string, trade_date date, fallback_symbol string")
    seen = [("a", days[1], "one", 1.0, 1.0), ("a", days[2], None, 1.0, 1.0)]
    bars = spark.createDataFrame(seen, "security_id string, trade_date date, symbol string, close double, dollar_volume double")
    found = attach_observations(grid, bars)
    assert [r["symbol"] for r in found.orderBy("trade_date").collect()] == ["late", "one", "one", "one"]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("$", "")


def test_empty_inner_split_stops(spark):
    days = weekdays(6)
    rows = [(f"s{i}", "a", d, days[-1], "train") for i, d in enumerate(days)]
    index = spark.createDataFrame(rows, "sample_id string, security_id string, asof_date date, label_end date, split string")
    with pytest.raises(ContractError):
        inner_selection_split(index, 0.2)


def test_fold_features_do_not_see_later_values(spark):
    days = weekdays(80)
    base = bar_rows("a", days) + bar_rows("b", days, lambda i: 50.0 + (i * 7) % 13)
    later = bar_rows("a", days, lambda i: 100.0 + i if i < 60 else 5000.0 - i * 11) + base[80:]
    universe = spark.createDataFrame(universe_rows("a", days) + universe_rows("b", days), UNIVERSE_COLUMNS)
    folds = [
        SplitDates(days[39], days[54], days[69], 1, "one"),
        SplitDates(days[49], days[64], days[77], 1, "two"),
    ]
    found = []
    for rows in (base, later):
        bars = spark.createDataFrame(rows, BAR_COLUMNS)
        raw = build_features(bars, universe)
        labels = build_labels(bars, universe)
        found.append(walk_forward_datasets(raw, labels, universe, folds, context_length=20, windows=(5, 20)))
    for before, after in zip(*found):
        early = F.col("trade_date") <= days[59]
        columns = ["security_id", "trade_date", *CHANNELS]
        same = [d.features.filter(early).select(*columns).orderBy(*columns[:2]).collect() for d in (before, after)]
        assert same[0] == same[1]
    one, two = found[0]
    assert one.samples.filter("split = 'valid'").count() > 0
    scalers = walk_forward_scalers(build_features(spark.createDataFrame(base, BAR_COLUMNS), universe), folds)
    own = apply_robust_scaler(
        build_features(spark.createDataFrame(base, BAR_COLUMNS), universe), scalers.filter("fold_id = 'two'")
    )
    key = ["security_id", "trade_date", *CHANNELS]
    assert own.select(*key).orderBy(*key[:2]).collect() == two.features.select(*key).orderBy(*key[:2]).collect()
