"""Ranking, quantiles and rolling statistics against plain computations."""

import random

import numpy as np
import pandas as pd
import pytest
from panel_data import weekdays
from pyspark.sql import functions as F

from factorloom.functions.quantiles import order_statistics
from factorloom.functions.ranking import with_average_rank, with_position
from factorloom.functions.rolling import STATISTICS, rolling_name, with_rolling


def skewed(spark, seed=3):
    """A third of all rows on one date, a third of its scores tied."""
    rng = random.Random(seed)
    data = []
    for date, count in (("d1", 300), ("d2", 80), ("d3", 1), (None, 250)):
        for i in range(count):
            score = 0.5 if rng.random() < 0.34 else rng.gauss(0, 1)
            data.append((date, f"s{i:04d}", score))
    rng.shuffle(data)
    return pd.DataFrame(data, columns=["date", "id", "score"]), spark.createDataFrame(
        data, "date string, id string, score double"
    ).repartition(6)


def test_position_and_size(spark):
    table, frame = skewed(spark)
    got = with_position(frame, "pos", [F.desc("score"), "id"], ["date"], size="n").toPandas()
    table = table.sort_values(["date", "score", "id"], ascending=[True, False, True])
    table["pos"] = table.groupby("date", dropna=False).cumcount() + 1
    table["n"] = table.groupby("date", dropna=False)["id"].transform("size")
    merged = got.merge(table, on=["date", "id"])
    assert len(merged) == len(table)
    assert len(got) == len(table)
    assert (merged.pos_x == merged.pos_y).all() and (merged.n_x == merged.n_y).all()


def test_global_position(spark):
    table, frame = skewed(spark)
    got = with_position(frame, "pos", ["date", "id"], size="n").orderBy("pos").toPandas()
    assert got.pos.tolist() == list(range(1, len(table) + 1))
    assert got.date.isna().tolist()[:250] == [True] * 250 and got.id[250:550].is_monotonic_increasing
    assert set(got.n) == {len(table)}


def test_average_rank(spark):
    table, frame = skewed(spark)
    got = with_average_rank(frame, "rank", "score", ["date"], unique=["id"]).toPandas()
    table["rank"] = table.groupby("date", dropna=False)["score"].rank(method="average")
    merged = got.merge(table, on=["date", "id"])
    assert len(merged) == len(table)
    assert np.allclose(merged.rank_x, merged.rank_y)


@pytest.mark.parametrize("bins, kept", [(4096, 1 << 16), (16, 40), (3, 1), (2, 0)])
def test_order_statistics_are_exact(spark, bins, kept):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=3001),
        "tied": np.repeat([1.0, 2.0, 3.0], [700, 1200, 90]),
        "heavy": np.concatenate([np.full(900, 0.25), rng.standard_cauchy(457)]),
        "scales": 10.0 ** rng.uniform(-3, 3, 400) * rng.choice([-1, 1], 400),
        "widest": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0]),
        "single": np.array([4.0]),
        "pair": np.array([1.0, 2.0]),
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None)]
    frame = spark.createDataFrame(data, "g string, v double").repartition(5)
    probabilities = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = order_statistics(frame, ["g"], "v", probabilities, bins=bins, kept=kept).collect()
    assert len(got) == len(groups) * len(probabilities)
    for row in got:
        ordered = np.sort(groups[row["g"]])
        place = (len(ordered) - 1) * row["probability"]
        assert row["low"] == ordered[int(place)] and row["high"] == ordered[min(int(place) + 1, len(ordered) - 1)]
        assert row["fraction"] == place - int(place) and row["n"] == len(ordered)


def test_order_statistics_with_infinities_and_nan(spark):
    values = [float("-inf")] * 3 + [0.0, 1.0, 2.0] + [float("inf")] * 2 + [float("nan")] * 4
    frame = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    for kept in (100, 1):
        got = order_statistics(frame, ["g"], "v", [k / 11 for k in range(12)], bins=2, kept=kept).collect()
        assert repr([r["low"] for r in got]) == repr(values)
    assert order_statistics(frame.limit(0), ["g"], "v", [0.5]).count() == 0
    whole = spark.createDataFrame([("a", v) for v in (5, 1, 9)], "g string, v long")
    assert order_statistics(whole, ["g"], "v", [0.5], kept=1).first()["low"] == 5


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(11)
    days = weekdays(70)
    table = pd.concat(
        pd.DataFrame(
            {
                "security_id": name,
                "trade_date": days,
                "x": np.where(rng.random(70) < gaps, np.nan, rng.normal(1e6, 1, 70)),
            }
        )
        for name, gaps in (("a", 0.0), ("b", 0.08))
    )
    plain = [(r.security_id, r.trade_date, None if np.isnan(r.x) else r.x) for r in table.itertuples()]
    frame = spark.createDataFrame(plain, "security_id string, trade_date date, x double")
    windows = [1, 2, 3, 5, 7, 20, 31, 64]
    got = with_rolling(frame, ["x"], windows).orderBy("security_id", "trade_date").toPandas()
    for w in windows:
        rolls = table.groupby("security_id")["x"].rolling(w, min_periods=w)
        expected = {
            "mean": rolls.mean(),
            "std": rolls.apply(lambda v: np.std(v), raw=True),
            "min": rolls.min(),
            "max": rolls.max(),
        }
        for s in STATISTICS:
            column = got[rolling_name("x", s, w)].to_numpy(dtype=float)
            want = expected[s].to_numpy()
            assert (np.isnan(column) == np.isnan(want)).all()
            assert np.nanmax(np.abs(column - want)) < 1e-8
