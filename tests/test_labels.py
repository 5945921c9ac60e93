"""Labels, splits, indexes, windows and batch plans."""

import datetime as dt
import math

import pytest
from panel_data import rows, weekdays
from pyspark.sql import functions as F

from factorloom.operators import windows as wn
from factorloom.operators.features import build_features
from factorloom.operators.indexes import inference_index, sample_index, sample_metadata, select_asof
from factorloom.operators.labels import build_labels, delisting_terms
from factorloom.operators.quality import temporal_violations
from factorloom.operators.sampling import date_grouped_batches, sequence_batches
from factorloom.operators.splits import (
    SplitDates,
    assign_splits,
    embargo_start,
    inner_selection_audit,
    inner_selection_split,
    pretraining_audit,
    pretraining_split,
    session_dates,
    walk_forward_splits,
)

DELISTING = (
    "security_id string, delist_date date, last_trade_date date, delisting_return double, "
    "terminal_value double, known_at date, source_revision string"
)


def price(i):
    return 100.0 + i


def test_label_by_hand(spark, panel):
    bars, universe, days = panel
    labels = {(r["security_id"], r["asof_date"]): r for r in build_labels(bars, universe).collect()}
    row = labels["a", days[10]]
    raw = math.log(price(15) * 1.002 / price(11))
    assert row["raw_return"] == pytest.approx(raw)
    assert (row["label_start"], row["label_end"]) == (days[11], days[15])
    mean = (raw + labels["b", days[10]]["raw_return"]) / 2
    assert row["benchmark_return"] == pytest.approx(mean)
    assert row["target"] == pytest.approx(raw - mean)
    assert labels["a", days[86]]["target"] is None and labels["a", days[86]]["label_end"] is None


def test_labels_look_up_sessions_not_rows(spark, panel):
    bars, universe, days = panel
    holed = bars.filter(F.col("trade_date") != F.lit(days[12]))
    stray = bars.limit(1).withColumn("trade_date", F.lit(dt.date(2023, 12, 31)))
    labels = {
        (r["security_id"], r["asof_date"]): r
        for r in build_labels(holed.unionByName(stray), universe).collect()
    }
    assert len(labels) == 180
    assert labels["a", days[11]]["raw_return"] is None
    assert labels["a", days[7]]["raw_return"] is None
    assert labels["a", days[12]]["raw_return"] == pytest.approx(math.log(price(17) * 1.002 / price(13)))


def test_delisting_inside_label(spark, panel):
    bars, universe, days = panel
    gone = spark.createDataFrame(
        [("b", days[41], days[40], -0.5, None, days[41], "r1")], DELISTING
    )
    kept = bars.filter((F.col("security_id") != "b") | (F.col("trade_date") <= F.lit(days[40])))
    labels = {(r["security_id"], r["asof_date"]): r for r in build_labels(kept, universe, gone).collect()}
    flags = [d for d in days if labels["b", d]["crosses_delisting"]]
    assert flags == days[36:41]
    last = (50.0 + (40 * 7) % 13) * 1.002 * 0.5
    entry = 50.0 + (38 * 7) % 13
    assert labels["b", days[37]]["raw_return"] == pytest.approx(math.log(last / entry))
    unresolved = gone.withColumn("last_trade_date", F.lit(dt.date(2000, 1, 1)))
    with pytest.raises(Exception, match="cannot derive a terminal value"):
        delisting_terms(kept, unresolved).collect()


def test_purge_and_embargo(spark, panel):
    bars, universe, days = panel
    split = SplitDates(days[39], days[59], days[79], 3)
    calendar = session_dates(universe)
    start = embargo_start(calendar, [split]).first()
    assert (start["valid_start"], start["test_start"]) == (days[43], days[63])
    labels = assign_splits(build_labels(bars, universe), calendar, split)
    a = {r["asof_date"]: r["split"] for r in labels.filter("security_id = 'a'").collect()}
    assert a[days[34]] == "train" and a[days[35]] is None and a[days[42]] is None
    assert a[days[43]] == "valid" and a[days[54]] == "valid" and a[days[55]] is None
    assert a[days[63]] == "test" and a[days[74]] == "test" and a[days[75]] is None
    with pytest.raises(Exception, match="embargoes"):
        assign_splits(labels.drop("split"), calendar, SplitDates(days[39], days[88], days[89], 3)).collect()
    folds = [split, SplitDates(days[49], days[69], days[84], 3, "later")]
    both = walk_forward_splits(labels.drop("split"), calendar, folds)
    assert both.count() == 2 * labels.count()
    one = both.filter("fold_id = 'base'").select("security_id", "asof_date", "split")
    assert one.exceptAll(labels.select("security_id", "asof_date", "split")).isEmpty()


def test_indexes(spark, panel):
    bars, universe, days = panel
    split = SplitDates(days[39], days[59], days[79], 3)
    features = build_features(bars, universe)
    labels = assign_splits(build_labels(bars, universe), session_dates(universe), split)
    index = sample_index(features, labels, universe, 30)
    first = index.orderBy("asof_date", "security_id").first()
    assert first["sample_id"] == f"a|{days[29]}" and first["feature_start"] == days[0]
    assert temporal_violations(index).isEmpty()
    live = inference_index(features, universe, 30)
    assert live.count() == 2 * 61 and "target" not in live.columns
    assert rows(select_asof(live).select("asof_date"), "asof_date") == [(days[89],)] * 2
    assert select_asof(live, str(days[50])).count() == 2
    assert select_asof(live, None, days[50], days[52]).count() == 6
    with pytest.raises(ValueError):
        select_asof(live, "2030-01-01")
    metadata = sample_metadata(index, universe)
    assert metadata.count() == index.count()
    assert metadata.first()["log_float_market_cap"] == pytest.approx(math.log(1e9))


def samples(spark, dates=10, names=2, span=2):
    days = weekdays(dates + span)
    data = [
        (f"s{n}|{days[i]}", f"s{n}", days[i], days[i + span], "train")
        for i in range(dates)
        for n in range(names)
    ]
    return spark.createDataFrame(
        data, "sample_id string, security_id string, asof_date date, label_end date, split string"
    )


def test_inner_selection(spark):
    index = samples(spark)
    protocol = inner_selection_split(index, 0.2)
    audit = inner_selection_audit(index, protocol).first()
    assert (audit["selection_rows"], audit["purged_rows"], audit["fit_rows"]) == (4, 4, 12)
    assert audit["disjoint"]
    with pytest.raises(Exception, match="3 train dates"):
        inner_selection_split(samples(spark, dates=2), 0.2).collect()


def test_pretraining_split(spark):
    index = samples(spark)
    protocol = pretraining_split(index, 0.25)
    audit = pretraining_audit(index, protocol).first()
    assert (audit["pretrain_rows"], audit["selection_rows"]) == (14, 6)
    assert audit["pretrain_max_asof_date"] < audit["selection_min_asof_date"] and audit["disjoint"]


def window_inputs(spark):
    days = weekdays(3)
    features = spark.createDataFrame(
        [("a", days[0], 2.0, True), ("a", days[1], float("nan"), True), ("a", days[2], 4.0, True)],
        "security_id string, trade_date date, x double, observed_x boolean",
    )
    index = spark.createDataFrame(
        [("a|1", "a", days[2], days[0], 0.5)],
        "sample_id string, security_id string, asof_date date, feature_start date, target double",
    )
    return features, index, days


def test_window_mask_and_bounds(spark):
    features, index, days = window_inputs(spark)
    row = wn.context_windows(features, index, channels=["x"], context_length=3).first()
    assert [v[0] for v in row["values"]] == [2.0, 0.0, 4.0]
    assert [m[0] for m in row["observed_mask"]] == [True, False, True]
    wrong = index.withColumn("feature_start", F.lit(days[1]))
    with pytest.raises(Exception, match="window bounds disagree"):
        wn.context_windows(features, wrong, channels=["x"], context_length=3).collect()


def test_patches_mask_and_loss(spark):
    features, index, _ = window_inputs(spark)
    windows = wn.context_windows(features, index, channels=["x"], context_length=3)
    patches = wn.patchify(windows, channels=["x"], context_length=3, length=1, stride=1)
    flat = wn.explode_patches(patches)
    assert rows(flat.select("patch_index", "patch_observed"), "patch_index") == [
        (0, True), (1, False), (2, True)
    ]
    masked = wn.masked_patch_sample(patches, ratio=0.4, seed=1)
    again = wn.masked_patch_sample(patches, ratio=0.4, seed=1)
    assert masked.collect() == again.collect()
    assert masked.filter("masked").count() == 2
    inputs = flat.withColumns(
        {"masked": F.col("patch_index") < 2, "prediction": F.array(F.lit(5.0))}
    )
    losses = {r["loss_name"]: (r["loss"], r["valid_elements"]) for r in wn.masked_reconstruction_loss(inputs).collect()}
    assert losses == {"mse": (9.0, 1), "huber": (2.5, 1)}
    with pytest.raises(ValueError):
        wn.masked_reconstruction_loss(inputs, losses=["mae"])


def test_sample_without_features_stops(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    features = spark.createDataFrame([("a", d, 1.0, True) for d in days], "security_id string, trade_date date, x double, observed_x boolean")
    index = spark.createDataFrame(
        [("a|1", "a", "A", days[2], days[0], "train", 0.1), ("b|1", "b", "B", days[2], days[0], "train", 0.1)],
        "sample_id string, security_id string, symbol string, asof_date date, feature_start date, split string, target double",
    )
    assert wn.context_windows(features, index.limit(1), channels=["x"], context_length=3).count() == 1
    with pytest.raises(Exception, match="window bounds disagree"):
        wn.context_windows(features, index, channels=["x"], context_length=3).collect()


@pytest.mark.parametrize("drop_last", [False, True])
def test_date_batches(spark, drop_last):
    index = samples(spark, dates=12, names=3).unionByName(
        spark.createDataFrame(
            [(f"big{i}", f"big{i}", dt.date(2023, 1, 2), dt.date(2023, 1, 4), "train") for i in range(23)],
            samples(spark, dates=1).schema,
        )
    )
    size = 8
    plan = date_grouped_batches(index, batch_size=size, seed=5, epoch=2, drop_last=drop_last)
    table = plan.toPandas()
    again = date_grouped_batches(index.repartition(7), batch_size=size, seed=5, epoch=2, drop_last=drop_last)
    assert sorted(map(tuple, plan.select("sample_id", "batch_id").collect())) == sorted(
        map(tuple, again.select("sample_id", "batch_id").collect())
    )
    counts = table.groupby("batch_id").size()
    assert counts.max() <= size and sorted(counts.index) == list(range(len(counts)))
    per_date = table.groupby("asof_date")["batch_id"].nunique()
    assert (per_date.drop(dt.date(2023, 1, 2)) <= 1).all()
    if not drop_last:
        assert len(table) == index.count() and per_date[dt.date(2023, 1, 2)] == 3
    other = date_grouped_batches(index, batch_size=size, seed=6).select("sample_id", "batch_id")
    assert not other.exceptAll(plan.select("sample_id", "batch_id")).isEmpty()


def test_sequence_batches(spark):
    index = samples(spark, dates=7, names=3)
    table = sequence_batches(index, batch_size=4, seed=1).toPandas()
    assert table.groupby("batch_id").size().tolist() == [4, 4, 4, 4, 4, 1]
    assert sequence_batches(index, batch_size=4, seed=1, drop_last=True).count() == 20
