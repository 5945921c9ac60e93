"""Standard tables, content-addressed snapshots and baseline models."""

import pytest
from panel_data import rows
from pyspark.sql import functions as F

from factorloom.functions.columns import ContractError
from factorloom.operators.scoring import (
    factor_frame,
    fit_linear_baseline,
    fit_tree_baseline,
    live_factor_frame,
    prediction_frame,
    score_table,
    score_with,
)
from factorloom.operators.quality import prediction_report
from factorloom.operators.splits import SplitDates
from factorloom.sources.snapshot import (
    DatasetConfig,
    content_hash,
    read_signal_snapshot,
    read_snapshot,
    source_research_ready,
    write_snapshot,
)
from factorloom.sources.tables import StandardTables, read_standard_tables


@pytest.fixture
def config(panel):
    days = panel[2]
    return DatasetConfig("test", SplitDates(days[39], days[59], days[79], 3), context_length=30)


def test_read_standard_tables(spark, panel, tmp_path):
    bars, universe, _ = panel
    bars.withColumn("trade_date", F.col("trade_date").cast("string")).write.parquet(f"{tmp_path}/bars")
    universe.write.parquet(f"{tmp_path}/universe")
    tables = read_standard_tables(spark, f"{tmp_path}/bars", f"{tmp_path}/universe")
    assert dict(tables.bars.dtypes)["trade_date"] == "date" and tables.delistings is None
    universe.withColumn("is_halted", F.lit(True)).write.parquet(f"{tmp_path}/halted")
    with pytest.raises(ContractError, match="rule_rows"):
        read_standard_tables(spark, f"{tmp_path}/bars", f"{tmp_path}/halted")
    universe.drop("eligible").write.parquet(f"{tmp_path}/short")
    with pytest.raises(ContractError, match="eligible"):
        read_standard_tables(spark, f"{tmp_path}/bars", f"{tmp_path}/short")


def test_snapshot_is_content_addressed(spark, panel, config, tmp_path):
    bars, universe, _ = panel
    tables = StandardTables(bars, universe)
    folder, manifest = write_snapshot(tables, config, str(tmp_path), {"selection": {"research_ready": False}})
    again, second = write_snapshot(
        StandardTables(bars.repartition(7), universe.orderBy(F.desc("trade_date"))), config, str(tmp_path)
    )
    assert folder == again and manifest["created_at"] == second["created_at"]
    assert content_hash(bars) != content_hash(bars.withColumn("close", F.col("close") + 1))
    loaded, frames = read_snapshot(spark, folder)
    assert loaded["dataset_id"] == manifest["dataset_id"]
    assert frames["sample_index"].count() > 0
    _, live = read_signal_snapshot(spark, folder)
    assert "target" not in live["inference_index"].columns
    assert source_research_ready(spark, folder) is False
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, f"{tmp_path}/none")
    with pytest.raises(ContractError):
        read_snapshot(spark, folder, minimum_schema=9)


def test_predictions_and_factors(spark, panel, config, tmp_path):
    folder, _ = write_snapshot(StandardTables(*panel[:2]), config, str(tmp_path))
    _, frames = read_snapshot(spark, folder)
    index = frames["sample_index"].filter("split = 'valid'")
    scores = index.select("sample_id", F.col("target").alias("score_raw"))
    ids = {"model_id": "m", "checkpoint_hash": "h", "dataset_id": "d"}
    predictions = prediction_frame(index, frames["sample_metadata"], scores, **ids)
    assert tuple(prediction_report(predictions).first()) == (0, 0, 0, 1, 1)
    factors = factor_frame(predictions)
    assert "target" not in factors.columns and factors.first()["signal_available"] == "after_close"
    live = frames["inference_index"]
    known = live.select("sample_id", F.lit(0.5).alias("score_raw"))
    assert live_factor_frame(live, known, **ids).count() == live.count()
    with pytest.raises(Exception, match="not finite"):
        live_factor_frame(live, known.limit(3), **ids).collect()


def test_baselines(spark):
    data = []
    for i in range(240):
        x = (i % 17) / 17 - 0.5
        split = "train_fit" if i < 160 else "inner_selection" if i < 200 else "valid"
        data.append((f"k{i}", split, 2 * x + (50.0 if i % 40 == 0 else 0.0), [x, float(i % 3)]))
    table = spark.createDataFrame(data, "sample_id string, split string, target double, vector array<float>")
    linear = score_table(fit_linear_baseline(table), table)
    assert linear.count() == 240
    got = dict(rows(linear, "sample_id"))
    assert abs(got["k201"] - 2 * ((201 % 17) / 17 - 0.5)) < 0.2
    trees = fit_tree_baseline(table, seed=3, rounds=4)
    assert score_table(trees, table).filter("score_raw IS NULL").isEmpty()
    doubled = score_with(table, lambda batch: [2 * v[0] for v in batch["vector"]])
    assert dict(rows(doubled, "sample_id"))["k0"] == pytest.approx(-1.0)
