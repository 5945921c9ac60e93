"""Queries on sources, sinks, contracts and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS
from factorloom.functions.session import fresh_path, materialize
from factorloom.operators import quality as q
from factorloom.operators.metrics import cross_section_stats
from factorloom.operators.scoring import factor_frame
from factorloom.plans import payload_stage as p
from factorloom.plans.ctes import d, fold_rows
from factorloom.plans.registry import query
from factorloom.plans.stage import (
    CONTEXT,
    FOLDS,
    HORIZON,
    LAG,
    REVISION,
    SEEDS,
    SPLIT,
    Stage,
    security_number,
)
from factorloom.sources import payloads
from factorloom.sources.snapshot import DatasetConfig, read_snapshot, write_snapshot
from factorloom.sources.tables import BARS, StandardTables, coerce_date, read_standard_tables

BAR_SQL = d("open", "high", "low", "close", "volume", "dollar_volume", "adj_factor")
SAMPLE_COLUMNS = f"""sample_id, security_id, symbol, asof_date, feature_start, feature_end,
    label_start, label_end, split, {d('target', 'raw_return', 'benchmark_return')}, crosses_delisting"""


# Sources and sinks


@query(
    "a1_read_standard_tables",
    f"SELECT security_id, symbol, trade_date, {BAR_SQL}, source_revision FROM bars",
)
def _(s: Stage) -> DataFrame:
    folder = fresh_path(s.spark, "inputs")
    for name, frame in (("bars", s.bars), ("universe", s.universe), ("delistings", s.delistings)):
        frame.write.parquet(f"{folder}/{name}")
    bundle = read_standard_tables(
        s.spark, f"{folder}/bars", f"{folder}/universe", delistings=f"{folder}/delistings"
    )
    return bundle.bars.select(
        "security_id",
        "symbol",
        "trade_date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "dollar_volume",
        "adj_factor",
        "source_revision",
    )


@query(
    "a2_map_eod_bars",
    f"""SELECT m.security_id, b.symbol, b.trade_date, round6(b.close) AS close,
        round6(b.close * b.volume) AS dollar_volume,
        round6(CASE WHEN k % 5 <> 0 THEN b.close * b.adj_factor ELSE b.close END / b.close)
            AS adj_factor,
        m.provider_symbol, m.identity_quality, m.exchange AS exchange_source,
        m.security_type AS security_type_source, m.is_delisted AS is_delisted_source
    FROM (SELECT *, CAST(substring(security_id, 5) AS BIGINT) AS k FROM bars) b
    JOIN {p.METADATA_SQL} m USING (provider_symbol)""",
)
def _(s: Stage) -> DataFrame:
    mapped = payloads.map_eod_bars(
        p.landed_eod(s),
        p.metadata(s),
        provider=p.PROVIDER,
        source_revision=REVISION,
        ingested_at=p.INGESTED,
    )
    return mapped.select(
        "security_id",
        "symbol",
        "trade_date",
        "close",
        "dollar_volume",
        "adj_factor",
        "provider_symbol",
        "identity_quality",
        "exchange_source",
        "security_type_source",
        "is_delisted_source",
    )


@query(
    "a3_map_corporate_actions",
    f"""SELECT security_id, ex_date, action_type, {d('price_factor', 'volume_factor', 'cash_amount')},
        known_at, provider_symbol, currency, known_at_quality
    FROM (
        SELECT coalesce(m.security_id, 'tpch:symbol:' || o.provider_symbol) AS security_id, ex_date,
            'cash_dividend' AS action_type, 1.0 AS price_factor, 1.0 AS volume_factor,
            cash_amount, CASE WHEN declared <= ex_date THEN declared ELSE ex_date END AS known_at,
            o.provider_symbol, 'USD' AS currency,
            CASE WHEN declared <= ex_date THEN 'declaration_date' ELSE 'ex_date_assumed' END
                AS known_at_quality
        FROM (SELECT 'S' || (o_custkey % 50) || '.US' AS provider_symbol,
                CAST(o_orderdate AS DATE) AS ex_date, o_totalprice / 1000 AS cash_amount,
                CASE o_orderkey % 4 WHEN 1 THEN CAST(o_orderdate AS DATE) - 10
                    WHEN 2 THEN CAST(o_orderdate AS DATE) + 3 WHEN 3 THEN CAST(o_orderdate AS DATE)
                    END AS declared
              FROM orders) o LEFT JOIN {p.METADATA_SQL} m USING (provider_symbol)
        UNION ALL
        SELECT 'tpch:symbol:P' || p_partkey || '.US', DATE '2000-01-01' + p_size, 'split',
            (p_partkey % 3 + 1) / (p_size % 4 + 1), (p_size % 4 + 1) / (p_partkey % 3 + 1), 0.0,
            DATE '2000-01-01' + p_size, 'P' || p_partkey || '.US', NULL, 'ex_date_assumed'
        FROM part)""",
)
def _(s: Stage) -> DataFrame:
    actions = payloads.map_corporate_actions(
        p.dividend_rows(s),
        p.split_rows(s),
        p.metadata(s),
        provider=p.PROVIDER,
        source_revision=REVISION,
    )
    return actions.drop("source_revision")


@query(
    "a4_build_metadata_index",
    f"""SELECT provider_symbol, isin, name, exchange, currency, security_type, is_delisted
    FROM {p.METADATA_SQL}""",
)
def _(s: Stage) -> DataFrame:
    return p.metadata(s)


@query(
    "a5_security_identity",
    f"SELECT provider_symbol, security_id, identity_quality FROM {p.METADATA_SQL}",
)
def _(s: Stage) -> DataFrame:
    named = payloads.identify(p.metadata(s), p.PROVIDER)
    return named.select("provider_symbol", "security_id", "identity_quality")


@query(
    "a6_union_batches",
    f"""SELECT security_id, trade_date, round6(close) AS close,
        CASE WHEN exchange_source = 'NASDAQ' THEN provider_symbol END AS provider_symbol,
        CASE WHEN exchange_source = 'NYSE' THEN identity_quality END AS identity_quality
    FROM bars""",
)
def _(s: Stage) -> DataFrame:
    columns = BARS.fieldNames()
    extra = {"NASDAQ": ["provider_symbol"], "NYSE": ["identity_quality"], "AMEX": []}
    return payloads.union_batches(
        [
            s.bars.filter(F.col("exchange_source") == market).select(*columns, *more)
            for market, more in extra.items()
        ],
        "bars",
    ).select("security_id", "trade_date", "close", "provider_symbol", "identity_quality")


def _snapshot(s: Stage) -> str:
    """The snapshot of the stage tables; written on first use, found again afterwards."""
    config = DatasetConfig(
        name="derived", split=SPLIT, context_length=CONTEXT, execution_lag=LAG, horizon=HORIZON
    )
    tables = StandardTables(s.bars, s.universe, delistings=s.delistings)
    folder, _ = write_snapshot(tables, config, s.snapshot_root)
    return folder


# Every artifact of the snapshot, as written and read again.
_ARTIFACTS = {
    "features": f"""SELECT security_id, symbol, trade_date, {d(*CHANNELS)},
        {', '.join('observed_' + c for c in CHANNELS)} FROM features""",
    "labels": f"""SELECT asof_date, security_id, label_start, label_end,
        {d('raw_return', 'benchmark_return', 'target')}, crosses_delisting, split FROM labels""",
    "sample_index": f"SELECT {SAMPLE_COLUMNS} FROM samples",
    "sample_metadata": f"""SELECT sample_id, security_id, symbol, asof_date, split, eligible,
        industry_code, {d('float_market_cap', 'log_float_market_cap')} FROM metadata""",
    "inference_index": f"""SELECT sample_id, security_id, symbol, asof_date, feature_start,
        feature_end, eligible, industry_code, {d('float_market_cap', 'log_float_market_cap')} FROM live""",
}


def _artifact(name: str):
    return lambda s: read_snapshot(s.spark, _snapshot(s), names=(name,))[1][name]


query("a7_write_snapshot", _ARTIFACTS["features"])(_artifact("features"))
query("a8_read_snapshot", _ARTIFACTS["sample_index"])(_artifact("sample_index"))
for _name in ("labels", "sample_metadata", "inference_index"):
    query(f"a8_read_snapshot_{_name}", _ARTIFACTS[_name])(_artifact(_name))


@query(
    "a9_write_factors",
    f"""SELECT security_id, symbol, asof_date, {d('score_raw', 'score_neutralized')}, split,
        'momentum' AS model_id, 'none' AS checkpoint_hash, 'base' AS dataset_id,
        'after_close' AS signal_available, 'next_session_open' AS earliest_execution
    FROM predictions""",
)
def _(s: Stage) -> DataFrame:
    return materialize(factor_frame(s.predictions), "factors")


# Contracts. The checks read whole tables in which some securities carry planted faults,
# picked by the security's number so that SQL can state the expected findings.


def faulty_bars(s: Stage) -> DataFrame:
    k = security_number()
    return s.bars.withColumns(
        {
            "high": F.when(k % 7 == 0, F.col("low") / 2).otherwise(F.col("high")),
            "volume": F.when(k % 11 == 0, -F.col("volume")).otherwise(F.col("volume")),
            "adj_factor": F.when(k % 13 == 0, float("nan")).otherwise(F.col("adj_factor")),
            "close": F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("close")),
        }
    )


FAULTY_BARS = """(SELECT * REPLACE (
        CASE WHEN k % 7 = 0 THEN low / 2 ELSE high END AS high,
        CASE WHEN k % 11 = 0 THEN -volume ELSE volume END AS volume,
        CASE WHEN k % 13 = 0 THEN 'NaN'::DOUBLE ELSE adj_factor END AS adj_factor,
        CASE WHEN k % 17 = 0 THEN NULL ELSE close END AS close)
    FROM (SELECT *, CAST(substring(security_id, 5) AS BIGINT) AS k FROM bars))"""

BAR_FAULT = """(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < greatest(open, close, low)
    OR low > least(open, close, high) OR volume < 0 OR dollar_volume < 0 OR adj_factor <= 0
    OR NOT isfinite(open) OR NOT isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close)
    OR NOT isfinite(volume) OR NOT isfinite(dollar_volume) OR NOT isfinite(adj_factor))"""


def doubled_bars(s: Stage) -> DataFrame:
    return s.bars.unionByName(s.bars.filter(security_number() % 5 == 0))


@query(
    "b2_duplicate_keys",
    """SELECT security_id, trade_date, CAST(2 AS BIGINT) AS copies FROM bars
    WHERE CAST(substring(security_id, 5) AS BIGINT) % 5 = 0""",
)
def _(s: Stage) -> DataFrame:
    return q.duplicate_keys(doubled_bars(s), ["security_id", "trade_date"])


@query(
    "b3_null_counts",
    f"""SELECT count(*) FILTER (security_id IS NULL) AS security_id,
        count(*) FILTER (adv20_usd IS NULL) AS adv20_usd, count(*) FILTER (close IS NULL) AS close
    FROM universe""",
)
def _(s: Stage) -> DataFrame:
    return q.null_counts(s.universe, ["security_id", "adv20_usd", "close"])


@query(
    "b4_coerce_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day
    FROM orders""",
)
def _(s: Stage) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("?"), text)).otherwise(text)
    return coerce_date(s.table("orders").select("o_orderkey", broken.alias("day")), "day")


@query("b5_bar_violations", f"SELECT security_id, trade_date FROM {FAULTY_BARS} WHERE {BAR_FAULT}")
def _(s: Stage) -> DataFrame:
    return q.bar_violations(faulty_bars(s)).select("security_id", "trade_date")


@query(
    "b6_universe_violations",
    """SELECT security_id, trade_date FROM universe WHERE eligible AND
    (CAST(substring(security_id, 5) AS BIGINT) % 3 = 0
     OR CAST(substring(security_id, 5) AS BIGINT) % 8 = 0)""",
)
def _(s: Stage) -> DataFrame:
    k = security_number()
    faulty = s.universe.withColumns(
        {
            "is_halted": F.col("is_halted") | (k % 3 == 0),
            "security_type": F.when(k % 8 == 0, "fund").otherwise(F.col("security_type")),
        }
    )
    return q.universe_violations(faulty).select("security_id", "trade_date")


@query(
    "b7_action_violations",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ex_date FROM orders
    WHERE o_orderkey % 4 = 2 OR o_orderkey % 9 = 0""",
)
def _(s: Stage) -> DataFrame:
    rows = p.dividend_rows(s)
    declared = F.coalesce("declarationDate", "date")
    actions = rows.select(
        "o_orderkey",
        F.to_date("date").alias("ex_date"),
        F.lit(1.0).alias("price_factor"),
        F.lit(1.0).alias("volume_factor"),
        F.when(F.col("o_orderkey") % 9 == 0, -1.0).otherwise(F.col("value")).alias("cash_amount"),
        F.to_date(declared).alias("known_at"),
    )
    return q.action_violations(actions).select("o_orderkey", "ex_date")


@query(
    "b8_delisting_violations",
    """SELECT security_id, CASE k % 4 WHEN 0 THEN 'late' WHEN 1 THEN 'empty' ELSE 'low' END AS fault
    FROM (SELECT security_id, CAST(substring(security_id, 5) AS BIGINT) // 10 AS k FROM delistings)
    WHERE k % 4 < 3""",
)
def _(s: Stage) -> DataFrame:
    k = F.floor(security_number() / 10) % 4
    faulty = s.delistings.withColumns(
        {
            "last_trade_date": F.when(k == 0, F.date_add("delist_date", 1)).otherwise(
                F.col("last_trade_date")
            ),
            "delisting_return": F.when(k == 1, F.lit(None))
            .when(k == 2, -1.5)
            .otherwise(F.col("delisting_return")),
            "fault": F.when(k == 0, "late").when(k == 1, "empty").otherwise("low"),
        }
    )
    return q.delisting_violations(faulty).select("security_id", "fault")


@query(
    "b9_table_audit",
    """SELECT 'bars' AS "table", count(*) AS rows, count(DISTINCT security_id) AS securities,
        min(trade_date) AS date_min, max(trade_date) AS date_max, '' AS null_counts FROM bars
    UNION ALL
    SELECT 'universe', count(*), count(DISTINCT security_id), min(trade_date), max(trade_date),
        concat_ws(',', CASE WHEN count(*) > count(adv20_usd)
                THEN 'adv20_usd=' || (count(*) - count(adv20_usd)) END,
            CASE WHEN count(*) > count(close) THEN 'close=' || (count(*) - count(close)) END,
            'liquidity_rank=' || count(*))
    FROM universe
    UNION ALL
    SELECT 'delistings', count(*), count(DISTINCT security_id), min(delist_date), max(delist_date),
        'terminal_value=' || count(*) FROM delistings""",
)
def _(s: Stage) -> DataFrame:
    audit = q.bundle_audit(StandardTables(s.bars, s.universe, delistings=s.delistings))
    entries = F.transform(
        "null_counts", lambda e: F.concat(e["column"], F.lit("="), e["nulls"].cast("string"))
    )
    return audit.withColumn("null_counts", F.array_join(entries, ","))


def faulty_predictions(s: Stage) -> DataFrame:
    k = security_number()
    rows = s.predictions.withColumns(
        {
            "score_raw": F.when(k % 7 == 0, float("inf")).otherwise(F.col("score_raw")),
            "symbol": F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("symbol")),
        }
    )
    return rows.unionByName(rows.filter(k % 5 == 0))


@query(
    "b10_prediction_violations",
    """SELECT CAST(sum(CASE WHEN k % 9 = 0 THEN copies ELSE 0 END) AS BIGINT) AS null_rows,
        count(*) FILTER (copies = 2) AS duplicate_keys,
        CAST(sum(CASE WHEN k % 7 = 0 THEN copies ELSE 0 END) AS BIGINT) AS non_finite_rows,
        CAST(1 AS BIGINT) AS models, CAST(1 AS BIGINT) AS datasets
    FROM (SELECT k, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS copies
          FROM (SELECT CAST(substring(security_id, 5) AS BIGINT) AS k FROM predictions))""",
)
def _(s: Stage) -> DataFrame:
    return q.prediction_report(faulty_predictions(s))


@query(
    "b11_prediction_coverage",
    """SELECT 'valid' AS split, e AS expected_rows, a AS prediction_rows, e - a AS missing_rows,
        CAST(0 AS BIGINT) AS unexpected_rows, round6(a / e) AS coverage,
        0.98 ::DOUBLE AS minimum_required, a / e >= 0.98 AS passed
    FROM (SELECT count(*) AS e,
            count(*) FILTER (CAST(substring(security_id, 5) AS BIGINT) % 6 <> 0) AS a
          FROM samples WHERE split = 'valid')""",
)
def _(s: Stage) -> DataFrame:
    # Planted: every sixth security has no prediction.
    partial = s.predictions.filter(security_number() % 6 != 0)
    return q.prediction_coverage(partial, s.samples, "valid", 0.98)


@query(
    "b12_feature_audit",
    "SELECT (SELECT count(*) FROM raw_features) AS rows, channel, "
    "round6(observed_ratio) AS observed_ratio FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, avg(CASE WHEN observed_{c} THEN 1.0 ELSE 0.0 END) "
        "AS observed_ratio FROM raw_features"
        for c in (
            "r_close",
            "r_gap",
            "r_intraday",
            "range",
            "dlog_volume",
            "vol20",
            "dollar_volume_z20",
        )
    )
    + ")",
)
def _(s: Stage) -> DataFrame:
    return q.feature_audit(s.raw_features)


@query(
    "b13_label_audit",
    """SELECT count(*) AS rows, count(target) AS target_non_null,
        count(*) FILTER (crosses_delisting) AS crosses_delisting,
        count(*) FILTER (crosses_delisting AND raw_return IS NULL) AS invalid_exit FROM labels""",
)
def _(s: Stage) -> DataFrame:
    return q.label_audit(s.labels)


@query("b13_split_counts", "SELECT split, count(*) AS rows FROM samples GROUP BY split")
def _(s: Stage) -> DataFrame:
    return q.split_counts(s.samples)


@query(
    "b13_index_audit",
    """SELECT count(*) AS rows, min(asof_date) AS minimum_asof_date,
        max(asof_date) AS maximum_asof_date,
        count(*) FILTER (asof_date = (SELECT max(asof_date) FROM live)) AS latest_cross_section_rows,
        false AS contains_target FROM live""",
)
def _(s: Stage) -> DataFrame:
    return q.index_audit(s.live)


@query(
    "b14_temporal_violations",
    """SELECT sample_id, asof_date FROM samples
    WHERE CAST(substring(security_id, 5) AS BIGINT) % 4 = 0
        OR CAST(substring(security_id, 5) AS BIGINT) % 6 = 0""",
)
def _(s: Stage) -> DataFrame:
    k = security_number()
    faulty = s.samples.withColumns(
        {
            "label_start": F.when(k % 4 == 0, F.col("asof_date")).otherwise(F.col("label_start")),
            "feature_end": F.when(k % 6 == 0, F.date_add("asof_date", 1)).otherwise(
                F.col("feature_end")
            ),
        }
    )
    return q.temporal_violations(faulty).select("sample_id", "asof_date")


@query(
    "b15_join_cardinality",
    """SELECT (SELECT count(*) FROM (SELECT 1 FROM universe GROUP BY security_id, trade_date
            HAVING count(*) > 1)) AS left_duplicates,
        count(*) AS right_duplicates, CASE WHEN count(*) > 0 THEN '1:m' ELSE '1:1' END AS cardinality
    FROM bars WHERE CAST(substring(security_id, 5) AS BIGINT) % 5 = 0""",
)
def _(s: Stage) -> DataFrame:
    return q.join_cardinality(s.universe, doubled_bars(s), ["security_id", "trade_date"])


@query(
    "b16_verify_targets",
    """SELECT security_id, asof_date, CASE WHEN k % 6 = 0 THEN 'missing_key' ELSE 'target_differs' END
        AS reason
    FROM (SELECT *, CAST(substring(security_id, 5) AS BIGINT) AS k FROM samples)
    WHERE k % 6 = 0 OR k % 5 = 0""",
)
def _(s: Stage) -> DataFrame:
    k = security_number()
    changed = s.predictions.withColumn(
        "target", F.when(k % 5 == 0, F.col("target") + 1e-6).otherwise(F.col("target"))
    )
    # Planted: every sixth security is missing from the index, every fifth target is moved.
    index = s.samples.filter(k % 6 != 0)
    return q.verify_targets(changed, index).select("security_id", "asof_date", "reason")


def two_runs(s: Stage) -> DataFrame:
    """The prediction table as two runs, the second scored backwards."""
    one = s.predictions.withColumn("run_id", F.lit("forward"))
    two = s.predictions.withColumns(
        {
            "run_id": F.lit("backward"),
            "score_raw": -F.col("score_raw"),
            "score_neutralized": -F.col("score_neutralized"),
        }
    )
    return one.unionByName(two)


@query(
    "b10_prediction_scopes",
    """SELECT count(DISTINCT k % 3) AS models, count(DISTINCT k % 2) AS datasets,
        (SELECT count(DISTINCT model_id) FROM (SELECT 'momentum' AS model_id FROM predictions
            WHERE split = 'none')) AS models_of_none
    FROM (SELECT CAST(substring(security_id, 5) AS BIGINT) AS k FROM predictions)""",
)
def _(s: Stage) -> DataFrame:
    # Planted: three models and two datasets in one table, and a table without rows.
    k = security_number()
    mixed = s.predictions.withColumns(
        {
            "model_id": F.concat(F.lit("m"), (k % 3).cast("string")),
            "dataset_id": F.concat(F.lit("d"), (k % 2).cast("string")),
        }
    )
    none = q.prediction_report(s.predictions.filter("split = 'none'")).select("models").scalar()
    return q.prediction_report(mixed).select("models", "datasets").withColumn("models_of_none", none)


@query(
    "b17_same_samples",
    """SELECT security_id, asof_date, CASE WHEN k % 8 = 0 THEN 1 ELSE 2 END::BIGINT AS runs,
        CASE WHEN k % 8 = 0 AND k % 3 = 0 THEN 2 WHEN k % 8 = 0 THEN 1 WHEN k % 3 = 0 THEN 3
            ELSE 2 END::BIGINT AS rows
    FROM (SELECT *, CAST(substring(security_id, 5) AS BIGINT) AS k FROM samples)
    WHERE k % 8 = 0 OR k % 7 = 0 OR k % 3 = 0""",
)
def _(s: Stage) -> DataFrame:
    k, second = security_number(), F.col("run_id") == "backward"
    # Planted in the second run: every eighth security is missing, every seventh moved; in the
    # first, every third is there twice.
    runs = (
        two_runs(s)
        .filter(~(second & (k % 8 == 0)))
        .withColumn(
            "target", F.when(second & (k % 7 == 0), F.col("target") + 1).otherwise(F.col("target"))
        )
    )
    again = runs.filter(~second & (k % 3 == 0))
    return q.same_samples(runs.unionByName(again)).select("security_id", "asof_date", "runs", "rows")


@query(
    "b18_verify_replay",
    """SELECT count(*) AS rows, count(*) FILTER (k % 6 = 0) AS key_or_target_differences,
        round6(max(abs(score_raw - moved)) FILTER (k % 6 <> 0)) AS maximum_absolute_difference,
        round6(avg(abs(score_raw - moved)) FILTER (k % 6 <> 0)) AS mean_absolute_difference,
        false AS matched
    FROM (SELECT *, CASE WHEN k % 5 = 0 THEN score_raw + 0.01 ELSE score_raw END AS moved
          FROM (SELECT *, CAST(substring(security_id, 5) AS BIGINT) AS k FROM predictions))""",
)
def _(s: Stage) -> DataFrame:
    k = security_number()
    # Planted: every sixth security is missing, every fifth score is moved.
    replayed = s.predictions.filter(k % 6 != 0).withColumn(
        "score_raw", F.when(k % 5 == 0, F.col("score_raw") + 0.01).otherwise(F.col("score_raw"))
    )
    return q.verify_replay(s.predictions, replayed)


@query(
    "b19_matrix_completeness",
    """SELECT 'fold_b' AS fold_id, CAST(seed AS BIGINT) AS seed, 'e2' AS model_key,
        'missing' AS problem FROM (VALUES (17), (42), (73)) t(seed)
    UNION ALL SELECT DISTINCT fold_id, CAST(99 AS BIGINT), 'e0', 'unexpected' FROM cell_scores""",
)
def _(s: Stage) -> DataFrame:
    # Planted: one fold lacks a model, and a seed outside the plan appears.
    cells = s.cells.filter("NOT (fold_id = 'fold_b' AND model_key = 'e2')")
    surplus = s.cells.filter("model_key = 'e0'").withColumn("seed", F.lit(99).cast("long"))
    return q.matrix_completeness(
        cells.unionByName(surplus), [f.fold_id for f in FOLDS], SEEDS, ["e0", "e1", "e2", "e3"]
    )


@query(
    "b20_universe_coverage",
    f"""SELECT fold_id, test_end, u.universe_rows, u.date_min, u.date_max, date_max >= test_end AS covers
    FROM {fold_rows(FOLDS)}, (SELECT count(*) AS universe_rows, min(trade_date) AS date_min,
        max(trade_date) AS date_max FROM universe) u""",
)
def _(s: Stage) -> DataFrame:
    folds = s.spark.createDataFrame(
        [(f.fold_id, f.test_end) for f in FOLDS], "fold_id string, test_end date"
    )
    return q.universe_coverage(s.universe, folds)


@query(
    "b21_readiness_gate",
    """SELECT split, source_ready, (dates >= 20 AND median >= 20) AND coalesce(source_ready, true)
        AS ready
    FROM (SELECT split, count(*) AS dates, median(c) AS median
          FROM (SELECT split, asof_date, count(*) AS c FROM predictions GROUP BY ALL) GROUP BY split),
        (VALUES (true), (false), (NULL)) v(source_ready)""",
)
def _(s: Stage) -> DataFrame:
    stats = cross_section_stats(s.predictions, ["split"])
    flags = F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    return stats.withColumn("source_ready", F.explode(flags)).select(
        "split",
        "source_ready",
        q.readiness_gate(F.col("research_ready"), F.col("source_ready")).alias("ready"),
    )
