"""Metrics, neutralisation, inference, research decisions, contracts and gates."""

import datetime as dt

import numpy as np
import pytest
from panel_data import BAR_COLUMNS, UNIVERSE_COLUMNS, bar_rows, rows, universe_rows, weekdays
from pyspark.sql import functions as F

from factorloom.functions.columns import ContractError
from factorloom.operators import metrics as mt
from factorloom.operators import quality as q
from factorloom.operators import research as rs
from factorloom.operators import statistics as st
from factorloom.operators.evaluation import evaluate_prediction_table
from factorloom.operators.neutralize import neutralization_audit, neutralize

D1, D2 = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
COLUMNS = (
    "security_id string, symbol string, asof_date date, score_raw double, score_neutralized double, "
    "target double, split string, model_id string, checkpoint_hash string, dataset_id string, "
    "eligible boolean, industry_code string, log_float_market_cap double"
)


@pytest.fixture
def predictions(spark):
    """Ten names on two dates; the score agrees with the target, then is reversed."""
    data = []
    for day, sign in ((D1, 1), (D2, -1)):
        for i in range(10):
            data.append(
                (f"s{i}", f"S{i}", day, float(sign * i), None, float(i), "valid", "m", "h", "d", True,
                 "x" if i % 2 else "y", 10.0 + i * i / 7)
            )
    return spark.createDataFrame(data, COLUMNS)


def test_ic_and_portfolio_by_hand(predictions):
    ic = mt.daily_ic(predictions).orderBy("asof_date").collect()
    assert [r["ic"] for r in ic] == pytest.approx([1, -1])
    assert [r["rank_ic"] for r in ic] == pytest.approx([1, -1])
    book = mt.daily_portfolio(predictions).orderBy("asof_date").collect()
    assert [r[mt.SPREAD] for r in book] == [8.0, -8.0]
    assert [r["turnover"] for r in book] == [None, 2.0]
    assert [r["net_10bps"] for r in book] == pytest.approx([8.0, -8.002])
    assert [r["groups"] for r in book] == [5, 5]


def test_turnover_matches_a_history(spark):
    rng = np.random.default_rng(2)
    days, data = weekdays(12), []
    for day in days:
        names = rng.choice(30, size=rng.integers(1, 25), replace=False)
        data += [(f"s{n:02d}", day, float(rng.normal()), float(rng.normal())) for n in names]
    frame = spark.createDataFrame(
        data, "security_id string, asof_date date, score_raw double, target double"
    )
    previous, expected = {}, {}
    for day in days:
        order = sorted((s, i) for i, d, s, _ in data if d == day)
        if len(order) < 2:
            continue
        k = max(1, len(order) // min(5, len(order)))
        weights = {i: -1 / k for _, i in order[:k]} | {i: 1 / k for _, i in order[-k:]}
        ids = set(weights) | set(previous)
        change = sum(abs(weights.get(i, 0) - previous.get(i, 0)) for i in ids)
        expected[day] = 0.5 * change if previous else None
        previous = weights
    got = {r["asof_date"]: r["turnover"] for r in mt.daily_portfolio(frame).collect()}
    assert set(got) == set(expected)
    for day, value in expected.items():
        assert got[day] == (None if value is None else pytest.approx(value))


def test_constant_side_and_single_row(spark):
    data = [("a", D1, 1.0, 1.0), ("b", D1, 1.0, 2.0), ("a", D2, 1.0, 1.0)]
    frame = spark.createDataFrame(
        data, "security_id string, asof_date date, score_raw double, target double"
    )
    assert rows(mt.daily_ic(frame), "asof_date") == [(D1, 2, None, None), (D2, 1, None, None)]
    summary = mt.aggregate_series(mt.daily_ic(frame), "ic").first()
    assert tuple(summary) == (0, None, None, None, None)


def test_neutralisation_is_least_squares(spark):
    rng = np.random.default_rng(9)
    data, expected = [], {}
    for d, day in enumerate(weekdays(60)):
        n = int(rng.integers(1, 14))
        industries = [f"i{v}" for v in rng.integers(0, 4, n)]
        caps = np.full(n, 3.0) if d % 9 == 0 else rng.normal(10, 2, n)
        scores = rng.normal(size=n)
        for i in range(n):
            data.append((f"s{i}", day, float(scores[i]), industries[i], float(caps[i])))
        names = sorted(set(industries))
        columns = [np.ones(n)]
        if caps.max() > caps.min():
            columns.append((caps - caps.mean()) / caps.std())
        columns += [np.array([float(x == name) for x in industries]) for name in names[1:]]
        design = np.column_stack(columns)
        fits = n >= 3 and n > design.shape[1] and np.linalg.matrix_rank(design) == design.shape[1]
        if fits:
            residual = scores - design @ np.linalg.lstsq(design, scores, rcond=None)[0]
        for i in range(n):
            expected[day, f"s{i}"] = float(residual[i]) if fits else None
    frame = spark.createDataFrame(
        data,
        "security_id string, asof_date date, score_raw double, industry_code string, "
        "log_float_market_cap double",
    )
    got = {
        (r["asof_date"], r["security_id"]): r["score_neutralized"] for r in neutralize(frame).collect()
    }
    assert any(v is None for v in expected.values()) and any(v is not None for v in expected.values())
    for key, value in expected.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-9))


def test_missing_exposures_stay_missing(predictions):
    bare = predictions.withColumn("industry_code", F.lit(None).cast("string"))
    done = neutralize(bare)
    assert done.filter("score_neutralized IS NOT NULL").isEmpty()
    audit = neutralization_audit(done).first()
    assert audit["quality"].startswith("unavailable_missing") and audit["dates"] == 2


def test_all_metric_tables(predictions):
    tables = mt.evaluate_predictions(neutralize(predictions))
    assert tables["cross_section"].first()["research_ready"] is False
    assert tables["by_industry"].count() == 2 and tables["by_year"].count() == 1
    assert rows(tables["by_size"].select("size_bucket"), "size_bucket") == [("large",), ("mid",), ("small",)]
    assert tables["ic"].count() == 4
    bare = mt.evaluate_predictions(predictions)
    assert {r["score"] for r in bare["ic"].collect()} == {"raw"}


def index_of(predictions):
    return predictions.select("security_id", "asof_date", "split", "target")


def test_evaluation_gates(predictions):
    index = index_of(predictions)
    tables = evaluate_prediction_table(predictions, index, "d", source_ready=True)
    assert tables["coverage"].first()["coverage"] == 1.0
    with pytest.raises(ContractError, match="coverage"):
        evaluate_prediction_table(predictions.filter("security_id != 's1'"), index, "d")
    with pytest.raises(ContractError, match="contract"):
        evaluate_prediction_table(predictions.unionByName(predictions.limit(1)), index, "d")
    with pytest.raises(ContractError, match="dataset_id"):
        evaluate_prediction_table(predictions, index, "other")
    moved = predictions.withColumn("target", F.col("target") + 1e-9)
    with pytest.raises(ContractError, match="targets"):
        evaluate_prediction_table(moved, index, "d")


def test_run_comparison(predictions):
    runs = predictions.withColumn("run_id", F.lit("a")).unionByName(
        predictions.withColumn("run_id", F.lit("b")).withColumn("score_raw", -F.col("score_raw"))
    )
    assert q.same_samples(runs).isEmpty()
    assert q.same_run_scope(runs).first()["comparable"]
    broken = runs.filter("NOT (run_id = 'b' AND security_id = 's3')")
    assert q.same_samples(broken).count() == 2
    expected = predictions.sparkSession.createDataFrame([("d", 20)], "dataset_id string, expected_rows long")
    compared = mt.compare_runs(runs, expected).orderBy("run_id").collect()
    assert [r["coverage"] for r in compared] == [1.0, 1.0]
    assert compared[0]["mean_turnover"] == 2.0


def test_replay(predictions):
    near = predictions.withColumn("score_raw", F.col("score_raw") * (1 + 1e-7))
    far = predictions.withColumn("score_raw", F.col("score_raw") + 1e-3)
    assert q.verify_replay(predictions, near).first()["matched"]
    assert not q.verify_replay(predictions, far).first()["matched"]
    assert not q.verify_replay(predictions, near.limit(19)).first()["matched"]


def series_frame(spark, groups):
    days = weekdays(50)
    data = [(f, days[i], v) for f, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "fold_id string, asof_date date, value double")


def reference_hac(groups, lags):
    whole = np.concatenate(list(groups.values()))
    n, mean = len(whole), whole.mean()
    used = min(lags, max(len(g) for g in groups.values()) - 1)
    total = sum(((g - mean) ** 2).sum() for g in groups.values()) / n
    for lag in range(1, used + 1):
        part = sum(((g[lag:] - mean) * (g[:-lag] - mean)).sum() for g in groups.values() if len(g) > lag)
        total += 2 * (1 - lag / (used + 1)) * part / n
    return mean, np.sqrt(max(total, 0) / n), used


def test_newey_west_and_strides(spark):
    hac = st.newey_west_mean(series_frame(spark, {"a": [1.0, 2.0, 3.0, 4.0]}), lags=0).first()
    assert hac["mean"] == 2.5
    assert hac["standard_error"] == pytest.approx(np.sqrt(sum((x - 2.5) ** 2 for x in (1, 2, 3, 4)) / 16))
    one = st.non_overlapping_mean(series_frame(spark, {"a": [1.0, 100.0, 2.0, 200.0, 3.0, 300.0]}), stride=2).first()
    assert (one["n"], one["mean"]) == (3, 2.0)
    two = st.panel_mean_inference(
        series_frame(spark, {"a": [1.0, 100.0, 2.0], "b": [3.0, 200.0, 4.0]}), lags=1, stride=2
    ).first()
    assert (two["non_overlapping_n"], two["non_overlapping_mean"]) == (4, 2.5)
    single = st.newey_west_mean(series_frame(spark, {"a": [5.0]}), lags=3).first()
    assert (single["n"], single["standard_error"], single["lags"]) == (1, None, 0)
    none = st.newey_west_mean(series_frame(spark, {"a": [float("nan")]}), lags=3).first()
    assert (none["n"], none["mean"], none["lags"]) == (0, None, 3)
    gap = st.non_overlapping_mean(series_frame(spark, {"a": [1.0, float("nan"), 5.0, 9.0]}), stride=2, offset=1).first()
    assert (gap["n"], gap["mean"]) == (1, 9.0)


@pytest.mark.parametrize("lags", [0, 1, 4, 30])
def test_panel_inference_against_numpy(spark, lags):
    rng = np.random.default_rng(lags)
    groups = {"a": rng.normal(size=17), "b": rng.normal(size=3), "c": rng.normal(size=1)}
    frame = series_frame(spark, {k: [float(x) for x in v] for k, v in groups.items()})
    got = st.panel_mean_inference(frame, lags=lags).first()
    mean, error, used = reference_hac(groups, lags)
    assert got["mean"] == pytest.approx(mean) and got["standard_error"] == pytest.approx(error)
    assert got["lags"] == used


def research_cells(spark, lift):
    days = weekdays(8)
    data = []
    for f, fold in enumerate(("f1", "f2", "f3")):
        for seed in (1, 2, 3):
            for m, model in enumerate(rs.MODEL_KEYS):
                for i, day in enumerate(days):
                    base = 0.01 + lift * m + 0.001 * ((i + seed + f) % 3)
                    for metric in (rs.RAW, rs.NEUTRALIZED, "net_20bps"):
                        data.append((fold, seed, model, day, metric, base))
    daily = spark.createDataFrame(
        data, "fold_id string, seed long, model_key string, asof_date date, metric string, value double"
    )
    cells = daily.select("fold_id", "seed", "model_key").distinct().withColumns(
        {
            "dataset_id": F.concat(F.lit("ds-"), "fold_id"),
            "evaluation_split": F.lit("valid"),
            "source_research_ready": F.lit(True),
        }
    )
    return cells, daily


def aggregate(cells, daily, **options):
    return rs.aggregate_research(
        cells, daily, folds=["f1", "f2", "f3"], seeds=[1, 2, 3], protocol=rs.Protocol(**options)
    )


def test_research_go_and_no_go(spark):
    cells, daily = research_cells(spark, 0.01)
    tables = aggregate(cells, daily)
    assert {r["status"] for r in tables["decisions"].collect()} == {"go"}
    assert tables["overall"].first()["status"] == "go"
    assert tables["paired_deltas"].first()["cell_count"] == 9
    unready = cells.withColumn("source_research_ready", F.lit(None).cast("boolean"))
    blocked = aggregate(unready, daily)
    assert {r["status"] for r in blocked["decisions"].collect()} == {"no_go"}
    assert "source provenance" in blocked["overall"].first()["reasons"][0]
    assert aggregate(unready, daily, require_source_ready=False)["overall"].first()["passed"]
    worse = aggregate(*research_cells(spark, -0.02))
    assert len(worse["decisions"].first()["reasons"]) == 2


def test_research_fails_closed(spark):
    cells, daily = research_cells(spark, 0.01)
    with pytest.raises(ContractError):
        aggregate(cells.filter("NOT (seed = 2 AND model_key = 'e1')"), daily)
    mixed = cells.withColumn("dataset_id", F.col("model_key"))
    with pytest.raises(ContractError):
        aggregate(mixed, daily)
    hole = daily.filter("NOT (fold_id = 'f1' AND seed = 1 AND model_key = 'e0')")
    with pytest.raises(Exception, match="no common dates"):
        rs.paired_delta(hole, rs.Protocol()).collect()


def test_contracts(spark):
    days = weekdays(3)
    bars = spark.createDataFrame(bar_rows("a", days), BAR_COLUMNS)
    assert tuple(q.contract_report(bars, "bars").first()) == (0, 0, 0)
    broken = bars.withColumn("high", F.col("low") / 2).unionByName(bars)
    assert tuple(q.contract_report(broken, "bars").first()) == (0, 3, 3)
    assert q.bar_violations(bars.withColumn("close", F.lit(None).cast("double"))).isEmpty()
    grid = spark.createDataFrame(universe_rows("a", days), UNIVERSE_COLUMNS)
    halted = grid.withColumn("is_halted", F.lit(True))
    assert q.universe_violations(halted).count() == 3 and q.universe_violations(grid).isEmpty()
    q.assert_join_cardinality(bars, grid, ["security_id", "trade_date"], "1:1")
    with pytest.raises(ContractError):
        q.assert_join_cardinality(bars, grid.unionByName(grid), ["security_id", "trade_date"], "m:1")
    gate = spark.range(1).select(
        *[q.readiness_gate(F.lit(True), F.lit(v).cast("boolean")) for v in (True, False, None)]
    )
    assert tuple(gate.first()) == (True, False, True)
