"""Provider mapping, universe, features, scaling."""

import datetime as dt
import math

import pytest
from panel_data import BAR_COLUMNS, bar_rows, rows, universe_rows, weekdays
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, ContractError
from factorloom.operators import universe as un
from factorloom.operators.features import (
    apply_robust_scaler,
    build_features,
    fit_robust_scaler,
)
from factorloom.operators.tabular import (
    fit_tabular_preprocessor,
    multiscale_features,
    transform_tabular,
)
from factorloom.sources import payloads as pl
from factorloom.sources.tables import coerce_date

META = [
    ("AAPL", "Apple", "NASDAQ", "USD", "Common Stock", "US0378331005", False, 1),
    ("old", "Old", "NYSE", None, "Common Stock", " ", True, 1),
]
META_COLUMNS = (
    "Code string, Name string, Exchange string, Currency string, Type string, Isin string, "
    "IsDelisted boolean, precedence int"
)


@pytest.fixture
def metadata(spark):
    return pl.build_metadata_index(spark.createDataFrame(META, META_COLUMNS), "US")


def eod(spark, symbol, days):
    return spark.createDataFrame(
        [(symbol, str(d), 100.0 + i, 102.0 + i, 99.0 + i, 100.0 + i, (100.0 + i) * 0.98, 1e6)
         for i, d in enumerate(days)],
        "provider_symbol string, date string, open double, high double, low double, close double, "
        "adjusted_close double, volume double",
    )


def test_bars_and_eligibility(spark, metadata):
    days = weekdays(28)
    bars = pl.map_eod_bars(
        eod(spark, "AAPL.US", days),
        metadata,
        provider="vendor",
        source_revision="r1",
        ingested_at="2024-03-01 00:00:00",
    )
    first = bars.first()
    assert first["security_id"] == "vendor:isin:US0378331005"
    assert first["adj_factor"] == pytest.approx(0.98)
    grid = un.build_universe(bars, min_listed_sessions=20, min_price=5, min_adv20_usd=1e6)
    assert grid.count() == 28 and grid.filter("eligible").count() == 9
    assert grid.select("exchange").distinct().collect()[0][0] == "XNAS"


def test_metadata_and_identity(metadata):
    named = {r["provider_symbol"]: r for r in pl.identify(metadata, "vendor").collect()}
    assert named["OLD.US"]["security_id"] == "vendor:symbol:OLD.US"
    assert named["OLD.US"]["identity_quality"] == "provider_symbol_fallback"
    assert named["OLD.US"]["currency"] == "USD"


def test_corporate_actions(spark, metadata):
    dividends = spark.createDataFrame(
        [("AAPL.US", "2024-02-09", "2024-02-01", 0.24, "USD"),
         ("AAPL.US", "2024-05-10", "2024-05-12", 0.25, "USD"),
         ("AAPL.US", "2024-08-10", None, 0.25, "USD")],
        "provider_symbol string, date string, declarationDate string, value double, currency string",
    )
    splits = spark.createDataFrame(
        [("AAPL.US", "2020-08-31", "4/1"), ("OLD.US", "2021-01-04", "1/5")],
        "provider_symbol string, date string, split string",
    )
    actions = pl.map_corporate_actions(
        dividends, splits, metadata, provider="vendor", source_revision="r1"
    )
    got = rows(actions.select("ex_date", "price_factor", "volume_factor", "known_at_quality"), "ex_date")
    assert got[0][1:3] == (0.25, 4.0) and got[1][1:3] == (5.0, 0.2)
    assert [g[3] for g in got[2:]] == ["declaration_date", "ex_date_assumed", "ex_date_assumed"]
    bad = spark.createDataFrame([("OLD.US", "2021-01-04", "5")], splits.schema)
    with pytest.raises(Exception, match="invalid split ratio"):
        pl.map_splits(bad, metadata, provider="vendor", source_revision="r1").collect()


def test_security_types(spark):
    values = ["Common Stock", " ETF ", "", None, "--", "Preferred-Stock", "stock", "Fund!"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in frame.orderBy("i").select(pl.normalize_security_type(F.col("v"))).collect()]
    assert got == [
        "common_stock", "etf", "unknown", "unknown", "unknown", "preferred_stock", "common_stock", "fund"
    ]


def test_coerce_date(spark):
    frame = spark.createDataFrame([("2024-01-05",), ("no",), (None,)], "d string")
    assert [r[0] for r in coerce_date(frame, "d").collect()] == [dt.date(2024, 1, 5), None, None]


def listed(spark, names, days, delisted=()):
    parts = []
    for name, last in names.items():
        frame = spark.createDataFrame(bar_rows(name, days[:last]), BAR_COLUMNS)
        parts.append(
            frame.withColumns(
                {
                    "exchange_source": F.lit("NYSE"),
                    "security_type_source": F.lit("Common Stock"),
                    "identity_quality": F.lit("isin"),
                    "provider_symbol": F.lit(name),
                    "is_delisted_source": F.lit(name in delisted),
                }
            )
        )
    return pl.union_batches(parts)


def test_delisting_ranges_and_imputation(spark):
    days = weekdays(30)
    bars = listed(spark, {"a": 30, "gone": 25}, days, delisted=("gone",))
    bars = bars.filter(~((F.col("security_id") == "a") & (F.col("trade_date") == F.lit(days[10]))))
    grid = un.build_universe(bars, min_listed_sessions=1, min_price=1, min_adv20_usd=1)
    gone = rows(grid.filter("security_id = 'gone'").select("trade_date", "is_delisted", "eligible"), "trade_date")
    assert len(gone) == 26 and gone[-1] == (days[25], True, False)
    halted = grid.filter("is_halted").collect()
    assert [(r["trade_date"], r["trade_status_quality"]) for r in halted] == [
        (days[10], "missing_bar_assumed_halt")
    ]
    assert halted[0]["symbol"] == "A"
    imputed = un.impute_delistings(bars, grid, source_revision="r1").collect()
    assert len(imputed) == 1
    row = imputed[0]
    assert (row["delist_date"], row["last_trade_date"]) == (days[25], days[24])
    assert row["delisting_return"] == -0.30 and row["imputation_method"] == "exchange_penalty:XNYS"


def test_daily_topk(spark):
    days = weekdays(22)
    bars = listed(spark, {"a": 22, "b": 22, "c": 22}, days)
    bars = bars.withColumn(
        "dollar_volume",
        F.when(F.col("security_id") == "c", 5e6).otherwise(F.lit(1e6)),
    )
    grid = un.build_universe(
        bars, min_listed_sessions=20, min_price=1, min_adv20_usd=1, max_daily_symbols=2
    )
    last = grid.filter(F.col("trade_date") == F.lit(days[-1]))
    assert rows(last.select("security_id", "liquidity_rank", "eligible"), "liquidity_rank") == [
        ("c", 1, True), ("a", 2, True), ("b", 3, False)
    ]
    assert grid.filter(F.col("trade_date") == F.lit(days[0])).filter("liquidity_rank IS NOT NULL").isEmpty()


def test_discovery_and_top_liquid(spark):
    columns = "Code string, Name string, Exchange string, Type string, Isin string"
    active = spark.createDataFrame(
        [("aa", "A", "NYSE", "Common Stock", None), ("bb", "B", "LSE", "Common Stock", None),
         ("cc", "C", "NASDAQ", "ETF", None), (" ", "D", "NYSE", "Common Stock", None),
         ("ee", "E", "nasdaq", "Stock", None)],
        columns,
    )
    gone = spark.createDataFrame([("AA", "A gone", "NYSE", "Common Stock", None)], columns)
    scope = {"exchange_code": "US", "exchanges": ["NYSE", "NASDAQ"], "security_types": ["common_stock"]}
    found = pl.discover_candidates(active, gone, **scope)
    assert rows(found.select("provider_symbol", "Name", "is_delisted"), "provider_symbol") == [
        ("AA.US", "A gone", True), ("EE.US", "E", False)
    ]
    audit = pl.discovery_audit(active, gone, found).first()
    assert (audit["active_candidates"], audit["delisted_candidates"], audit["candidate_count"]) == (2, 1, 2)
    bulk = spark.createDataFrame(
        [("AA", "2024-01-02", "10", "200000"), ("EE", "2024-01-02", "bad", "1e9"), ("EE", "2024-01-02", "20", "150000")],
        "code string, date string, close string, avgvol_200d string",
    )
    floors = {"min_price": 5.0, "min_avg_volume": 1e5}
    top = pl.select_top_liquid(active, bulk, k=2, **scope, **floors)
    assert rows(top.select("liquidity_rank", "provider_symbol"), "liquidity_rank") == [
        (1, "EE.US"), (2, "AA.US")
    ]
    with pytest.raises(ValueError):
        pl.select_top_liquid(active, bulk, k=3, **scope, **floors)


def test_features_by_hand_and_without_look_ahead(spark, panel):
    bars, universe, days = panel
    features = build_features(bars, universe)
    a = {r["trade_date"]: r for r in features.filter("security_id = 'a'").collect()}
    assert a[days[0]]["r_close"] is None and not a[days[0]]["observed_r_close"]
    assert a[days[1]]["r_close"] == pytest.approx(math.log(101 / 100))
    assert a[days[1]]["r_gap"] == pytest.approx(math.log(101 / 100.2))
    assert a[days[5]]["range"] == pytest.approx(math.log(1.01 / 0.99))
    assert a[days[1]]["dlog_volume"] == pytest.approx(math.log(1002 / 1001))
    assert a[days[18]]["dollar_volume_z20"] is None and a[days[19]]["dollar_volume_z20"] is not None
    assert a[days[19]]["vol20"] is None and a[days[20]]["vol20"] is not None
    cut = F.lit(days[60])
    changed = bars.withColumn(
        "close", F.when(F.col("trade_date") > cut, F.col("close") * 3).otherwise(F.col("close"))
    ).withColumn("high", F.greatest("high", "close"))
    before = features.filter(F.col("trade_date") <= cut)
    after = build_features(changed, universe).filter(F.col("trade_date") <= cut)
    assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_scaler_sees_training_rows_only(spark, panel):
    bars, universe, days = panel
    features = build_features(bars, universe)
    fitted = {r["channel"]: tuple(r) for r in fit_robust_scaler(features, days[50]).collect()}
    late = F.col("trade_date") > F.lit(days[50])
    spoiled = features.withColumn("r_close", F.when(late, 99.0).otherwise(F.col("r_close")))
    again = {r["channel"]: tuple(r) for r in fit_robust_scaler(spoiled, days[50]).collect()}
    assert fitted == again and set(fitted) == set(CHANNELS)
    scaled = apply_robust_scaler(features, fit_robust_scaler(features, days[50]))
    assert scaled.filter("r_close IS NULL").count() == 2
    with pytest.raises(ContractError):
        nothing = features.withColumn("vol20", F.lit(None).cast("double"))
        apply_robust_scaler(nothing, fit_robust_scaler(nothing, days[50]))


def test_multiscale_and_preprocessor(spark):
    days = weekdays(5)
    data = [("a", d, float(i)) for i, d in enumerate(days)]
    features = spark.createDataFrame(data, "security_id string, trade_date date, x double")
    index = spark.createDataFrame(
        [(f"a|{d}", "a", "A", d, "train", 0.1) for d in days[1:]],
        "sample_id string, security_id string, symbol string, asof_date date, split string, target double",
    )
    tabular = multiscale_features(features, index, channels=["x"], windows=[3, 9], context_length=4)
    got = {r["asof_date"]: r for r in tabular.collect()}
    assert len(got) == 4 and got[days[4]]["x__mean_3"] == 3.0 and got[days[4]]["x__last"] == 4.0
    assert got[days[1]]["x__mean_3"] is None and "x__mean_9" not in tabular.columns
    columns = ["x__last", "x__mean_3"]
    fitted = fit_tabular_preprocessor(tabular, columns)
    vectors = {r["asof_date"]: r["vector"] for r in transform_tabular(tabular, fitted, columns).collect()}
    assert vectors[days[1]][1] == 0.0 and vectors[days[1]][2:] == [1.0, 0.0]
    assert sum(v[0] for v in vectors.values()) == pytest.approx(0.0, abs=1e-6)
