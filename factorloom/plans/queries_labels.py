"""Queries on labels, splits, indexes, batches and scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS
from factorloom.functions.session import materialize
from factorloom.operators import indexes as ix
from factorloom.operators import labels as lb
from factorloom.operators import sampling as sm
from factorloom.operators import scoring as sc
from factorloom.operators import splits as sp
from factorloom.operators.tabular import (
    fit_tabular_preprocessor,
    multiscale_inference_features,
    transform_tabular,
)
from factorloom.plans.ctes import d, fold_bounds, ln_ratio, neutral
from factorloom.plans.queries_tables import SAMPLE_COLUMNS
from factorloom.plans.registry import query
from factorloom.plans.stage import (
    HORIZON,
    LAG,
    LINEAGE,
    Stage,
)

KEYS = ["security_id", "trade_date"]
BATCH, SEED, FRACTION = 64, 17, 0.1


@query("e1_session_offsets", "SELECT trade_date, session, label_start, label_end FROM sessions")
def _(s: Stage) -> DataFrame:
    return lb.session_offsets(s.universe, LAG, HORIZON)


@query(
    "e2_forward_return",
    f"""SELECT security_id, trade_date, label_start, label_end, {d('entry_value', 'normal_exit')},
        round6({ln_ratio('normal_exit', 'entry_value')}) AS normal_return
    FROM normal_returns""",
)
def _(s: Stage) -> DataFrame:
    return lb.forward_return(s.bars, s.universe, LAG, HORIZON).drop("eligible")


@query(
    "e3_delisting_terms",
    f"SELECT security_id, delist_date, {d('terminal_value')} FROM terms",
)
def _(s: Stage) -> DataFrame:
    return lb.delisting_terms(s.bars, s.delistings)


@query(
    "e4_crosses_delisting",
    f"SELECT security_id, trade_date, crosses_delisting, {d('exit_value')} FROM exits",
)
def _(s: Stage) -> DataFrame:
    panel = lb.forward_return(s.bars, s.universe, LAG, HORIZON)
    flagged = lb.crosses_delisting(panel, lb.delisting_terms(s.bars, s.delistings))
    return flagged.select(*KEYS, "crosses_delisting", "exit_value")


@query(
    "e5_benchmark_and_target",
    f"""SELECT asof_date, security_id, label_start, label_end,
        {d('raw_return', 'benchmark_return', 'target')}, crosses_delisting FROM plain_labels""",
)
def _(s: Stage) -> DataFrame:
    return lb.build_labels(s.bars, s.universe, s.delistings, LAG, HORIZON)


@query(
    "e6_embargo_start",
    lambda l: f"SELECT fold_id, valid_start, test_start FROM ({fold_bounds((l.split, *l.folds))})",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    starts = sp.embargo_start(s.calendar, (s.layout.split, *s.layout.folds))
    return starts.select("fold_id", "valid_start", "test_start")


@query("e7_assign_splits", "SELECT security_id, asof_date, split FROM labels", weekly=True)
def _(s: Stage) -> DataFrame:
    return sp.assign_splits(s.plain_labels, s.calendar, s.layout.split).select(
        "security_id", "asof_date", "split"
    )


@query("e8_sample_index", f"SELECT {SAMPLE_COLUMNS} FROM samples", weekly=True)
def _(s: Stage) -> DataFrame:
    return ix.sample_index(s.features, s.labels, s.universe, s.layout.context)


@query(
    "e9_inference_index",
    f"""SELECT sample_id, security_id, symbol, asof_date, feature_start, feature_end, eligible,
        industry_code, {d('float_market_cap', 'log_float_market_cap')} FROM live""",
)
def _(s: Stage) -> DataFrame:
    return ix.inference_index(s.features, s.universe, s.layout.context)


@query(
    "e10_sample_metadata",
    f"""SELECT sample_id, security_id, symbol, asof_date, split, eligible, industry_code,
        {d('float_market_cap', 'log_float_market_cap')} FROM metadata""",
)
def _(s: Stage) -> DataFrame:
    return ix.sample_metadata(s.samples, s.universe)


def _tail(fraction: float, keep: int) -> str:
    return f"""(SELECT min(asof_date) FROM (SELECT asof_date,
            row_number() OVER (ORDER BY asof_date DESC) AS i, count(*) OVER () AS total
        FROM (SELECT DISTINCT asof_date FROM samples WHERE split = 'train'))
        WHERE i <= least(greatest(1, ceil(total * {fraction}::DOUBLE)), total - {keep}))"""


_INNER = f"""(SELECT * REPLACE (CASE WHEN split <> 'train' THEN split
            WHEN asof_date >= {_tail(FRACTION, 2)} THEN 'inner_selection'
            WHEN label_end < {_tail(FRACTION, 2)} THEN 'train_fit' END AS split)
        FROM samples)"""
_PRE = f"""(SELECT * REPLACE (CASE WHEN asof_date >= {_tail(FRACTION, 1)} THEN 'pretrain_selection'
            ELSE 'pretrain_train' END AS split) FROM samples WHERE split = 'train')"""


@query(
    "e11_inner_selection_split",
    f"SELECT sample_id, asof_date, split FROM {_INNER} WHERE split IS NOT NULL",
)
def _(s: Stage) -> DataFrame:
    return sp.inner_selection_split(s.samples, FRACTION).select("sample_id", "asof_date", "split")


@query(
    "e11_inner_selection_audit",
    f"""SELECT *, official_train_rows - fit_rows - selection_rows AS purged_rows,
        fit_max_label_end < selection_min_asof_date AS disjoint
    FROM (SELECT count(*) FILTER (split = 'train_fit') AS fit_rows,
            count(*) FILTER (split = 'inner_selection') AS selection_rows,
            min(asof_date) FILTER (split = 'train_fit') AS fit_min_asof_date,
            max(asof_date) FILTER (split = 'train_fit') AS fit_max_asof_date,
            max(label_end) FILTER (split = 'train_fit') AS fit_max_label_end,
            min(asof_date) FILTER (split = 'inner_selection') AS selection_min_asof_date,
            max(asof_date) FILTER (split = 'inner_selection') AS selection_max_asof_date,
            count(*) FILTER (split = 'valid') AS outer_validation_rows,
            count(*) FILTER (split = 'test') AS outer_test_rows,
            (SELECT count(*) FROM samples WHERE split = 'train') AS official_train_rows
          FROM {_INNER})""",
)
def _(s: Stage) -> DataFrame:
    return sp.inner_selection_audit(s.samples, sp.inner_selection_split(s.samples, FRACTION))


@query("e12_pretraining_split", f"SELECT sample_id, asof_date, split FROM {_PRE}")
def _(s: Stage) -> DataFrame:
    return sp.pretraining_split(s.samples, FRACTION).select("sample_id", "asof_date", "split")


@query(
    "e12_pretraining_audit",
    f"""SELECT *, selection_max_asof_date < formal_valid_min_asof_date
            AND selection_max_asof_date < formal_test_min_asof_date AS disjoint
    FROM (SELECT count(*) AS official_train_rows,
            count(*) FILTER (split = 'pretrain_train') AS pretrain_rows,
            count(*) FILTER (split = 'pretrain_selection') AS selection_rows,
            min(asof_date) FILTER (split = 'pretrain_train') AS pretrain_min_asof_date,
            max(asof_date) FILTER (split = 'pretrain_train') AS pretrain_max_asof_date,
            min(asof_date) FILTER (split = 'pretrain_selection') AS selection_min_asof_date,
            max(asof_date) FILTER (split = 'pretrain_selection') AS selection_max_asof_date,
            (SELECT min(asof_date) FROM samples WHERE split = 'valid') AS formal_valid_min_asof_date,
            (SELECT min(asof_date) FROM samples WHERE split = 'test') AS formal_test_min_asof_date
          FROM {_PRE})""",
)
def _(s: Stage) -> DataFrame:
    return sp.pretraining_audit(s.samples, sp.pretraining_split(s.samples, FRACTION))


_ORDER = f"md5('{SEED}:1|' || sample_id), sample_id"
# Dates in their seeded order, packed one after the other: open batch and its rows so far.
_PACKED = f"""(WITH RECURSIVE dates AS (
        SELECT asof_date, count(*) AS n,
            row_number() OVER (ORDER BY md5('{SEED}:1|' || strftime(asof_date, '%Y-%m-%d')), asof_date) AS i
        FROM samples GROUP BY asof_date
    ), packed AS (
        SELECT 0::BIGINT AS i, NULL::DATE AS asof_date, 0::BIGINT AS n, 0::BIGINT AS first_batch,
            0::BIGINT AS last_batch, 0::BIGINT AS batch, 0::BIGINT AS filled
        UNION ALL
        SELECT i, asof_date, n, first_batch, last_batch,
            CASE WHEN held = {BATCH} THEN last_batch + 1 ELSE last_batch END,
            CASE WHEN held = {BATCH} THEN 0 ELSE held END
        FROM (SELECT *, first_batch + whole + CASE WHEN moved THEN 1 ELSE 0 END AS last_batch,
                CASE WHEN moved THEN 0 ELSE start END + rest AS held
            FROM (SELECT *, rest > 0 AND start + rest > {BATCH} AS moved
                FROM (SELECT d.i, d.asof_date, d.n, d.n // {BATCH} AS whole, d.n % {BATCH} AS rest,
                        p.batch + CASE WHEN d.n >= {BATCH} AND p.filled > 0 THEN 1 ELSE 0 END AS first_batch,
                        CASE WHEN d.n >= {BATCH} THEN 0 ELSE p.filled END AS start
                    FROM packed p JOIN dates d ON d.i = p.i + 1)))
    )
    SELECT asof_date, n, first_batch, last_batch FROM packed WHERE i > 0)"""


@query(
    "e13_date_grouped_batches",
    f"""SELECT sample_id, asof_date, CASE WHEN i // {BATCH} < n // {BATCH} THEN first_batch + i // {BATCH}
        ELSE last_batch END AS batch_id
    FROM (SELECT sample_id, asof_date, row_number() OVER (PARTITION BY asof_date ORDER BY {_ORDER}) - 1 AS i
        FROM samples) JOIN {_PACKED} USING (asof_date)""",
)
def _(s: Stage) -> DataFrame:
    plan = sm.date_grouped_batches(s.samples, batch_size=BATCH, seed=SEED, epoch=1)
    return plan.select("sample_id", "asof_date", "batch_id")


@query(
    "e13_date_grouped_batch_sizes",
    f"""SELECT asof_date, count(*) AS rows, (count(*) + {BATCH - 1}) // {BATCH} AS fewest_batches,
        true AS whole_when_it_fits FROM samples GROUP BY asof_date""",
)
def _(s: Stage) -> DataFrame:
    plan = sm.date_grouped_batches(s.samples, batch_size=BATCH, seed=SEED, epoch=1)
    per_date = plan.groupBy("asof_date", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    return per_date.groupBy("asof_date").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("fewest_batches"),
        ((F.sum("n") > BATCH) | (F.count(F.lit(1)) == 1)).alias("whole_when_it_fits"),
    )


@query(
    "e14_sequence_batches",
    f"SELECT sample_id, (row_number() OVER (ORDER BY {_ORDER}) - 1) // {BATCH} AS batch_id FROM samples",
)
def _(s: Stage) -> DataFrame:
    plan = sm.sequence_batches(s.samples, batch_size=BATCH, seed=SEED, epoch=1)
    return plan.select("sample_id", "batch_id")


@query(
    "e14_sequence_batch_sizes",
    f"""SELECT b AS batch_id, count(*) AS rows, count(*) AS samples
    FROM (SELECT (row_number() OVER (ORDER BY sample_id) - 1) // {BATCH} AS b FROM samples) GROUP BY b""",
)
def _(s: Stage) -> DataFrame:
    plan = sm.sequence_batches(s.samples, batch_size=BATCH, seed=SEED, epoch=1)
    return plan.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("samples")
    )


@query(
    "e13_date_grouped_samples",
    "SELECT sample_id, CAST(1 AS BIGINT) AS batches FROM samples",
)
def _(s: Stage) -> DataFrame:
    plan = sm.date_grouped_batches(s.samples, batch_size=BATCH, seed=SEED, epoch=1)
    return plan.groupBy("sample_id").agg(F.count("batch_id").alias("batches"))


@query(
    "e14_ordered_sequence_batches",
    f"""SELECT sample_id, (row_number() OVER (ORDER BY asof_date, security_id) - 1) // {BATCH}
        AS batch_id FROM samples""",
)
def _(s: Stage) -> DataFrame:
    plan = sm.sequence_batches(s.samples, batch_size=BATCH, seed=SEED, shuffle=False)
    return plan.select("sample_id", "batch_id")


@query(
    "e15_walk_forward_folds",
    "SELECT fold_id, security_id, asof_date, split FROM fold_labels",
)
def _(s: Stage) -> DataFrame:
    folds = sp.walk_forward_splits(s.plain_labels, s.calendar, s.layout.folds)
    return folds.select("fold_id", "security_id", "asof_date", "split")


def _fold_scaler(fold) -> str:
    return f"""SELECT '{fold.fold_id}' AS fold_id, channel, round6(lo) AS winsor_lower_value,
        round6(hi) AS winsor_upper_value, round6(quantile_cont(v, 0.5)) AS median,
        round6((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349) AS scale,
        count(*) AS train_observations
    FROM (SELECT channel, lo, hi, least(greatest(value, lo), hi) AS v
        FROM (SELECT *, quantile_cont(value, 0.005) OVER (PARTITION BY channel) AS lo,
                quantile_cont(value, 0.995) OVER (PARTITION BY channel) AS hi
            FROM (SELECT channel, value FROM (SELECT {', '.join(CHANNELS)} FROM raw_features
                    WHERE trade_date <= DATE '{fold.train_end}')
                UNPIVOT (value FOR channel IN ({', '.join(CHANNELS)})))))
    GROUP BY channel, lo, hi"""


@query(
    "e15_walk_forward_scalers",
    lambda l: " UNION ALL ".join(_fold_scaler(f) for f in l.folds),
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return sp.walk_forward_scalers(s.raw_features, s.layout.folds)


@query(
    "e15_fold_features",
    f"""SELECT fold_id, security_id, trade_date, {d(*CHANNELS)},
        {', '.join('observed_' + c for c in CHANNELS)} FROM fold_features""",
)
def _(s: Stage) -> DataFrame:
    return s.fold_features.drop("symbol")


@query(
    "e15_fold_samples",
    f"""SELECT fold_id, sample_id, security_id, symbol, asof_date, feature_start, feature_end,
        label_start, label_end, split, {d('target', 'raw_return', 'benchmark_return')},
        crosses_delisting FROM fold_samples""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return s.fold_samples


@query(
    "e15_fold_tabular",
    lambda l: f"""SELECT fold_id, sample_id, security_id, symbol, asof_date, split, {d('target')},
        {d(*l.columns)} FROM fold_tabular""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return s.fold_tabular.select(
        "fold_id", "sample_id", "security_id", "symbol", "asof_date", "split", "target", *s.layout.columns
    )


@query(
    "e16_select_asof",
    """SELECT sample_id, asof_date, 'latest' AS pick FROM live
        WHERE asof_date = (SELECT max(asof_date) FROM live)
    UNION ALL SELECT sample_id, asof_date, 'day' FROM live WHERE asof_date = DATE '2000-03-01'
    UNION ALL SELECT sample_id, asof_date, 'range' FROM live
        WHERE asof_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'""",
)
def _(s: Stage) -> DataFrame:
    picks = {
        "latest": ix.select_asof(s.live),
        "day": ix.select_asof(s.live, "2000-03-01"),
        "range": ix.select_asof(s.live, None, dt.date(1999, 1, 1), dt.date(1999, 6, 30)),
    }
    parts = [
        rows.select("sample_id", "asof_date", F.lit(name).alias("pick"))
        for name, rows in picks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Scoring

_LINEAGE_SQL = "'momentum' AS model_id, 'none' AS checkpoint_hash, 'base' AS dataset_id"


@query(
    "f1_prediction_frame",
    f"""SELECT security_id, symbol, asof_date, split, {d('target', 'score_raw', 'score_neutralized')},
        eligible, industry_code, {d('log_float_market_cap')}, {_LINEAGE_SQL} FROM predictions""",
)
def _(s: Stage) -> DataFrame:
    scores = s.tabular.select("sample_id", sc.momentum_score("r_close__mean_20").alias("score_raw"))
    return sc.prediction_frame(s.samples, s.metadata, scores, **LINEAGE)


_live_scored = """(SELECT l.security_id, l.symbol, l.asof_date, l.eligible, l.industry_code,
        l.log_float_market_cap, round(coalesce(r.r_close__mean_20, 0.0), 9) AS score_raw
    FROM live l JOIN rolled r USING (security_id, asof_date))"""


@query(
    "f2_live_factor_frame",
    f"""SELECT security_id, symbol, asof_date, eligible, industry_code, {d('log_float_market_cap')},
        {d('score_raw', 'score_neutralized')}, {_LINEAGE_SQL}, 'after_close' AS signal_available,
        'next_session_open' AS earliest_execution FROM ({neutral(_live_scored)})""",
)
def _(s: Stage) -> DataFrame:
    tabular = multiscale_inference_features(
        s.features, s.live, channels=["r_close"], windows=[20], context_length=s.layout.context
    )
    scores = tabular.select("sample_id", sc.momentum_score("r_close__mean_20").alias("score_raw"))
    return sc.live_factor_frame(s.live, scores, **LINEAGE)


def _vectors(s: Stage) -> DataFrame:
    """Tabular rows with inner splits, standardised on train_fit only."""
    columns = s.layout.columns
    inner = sp.inner_selection_split(s.samples, FRACTION).select("sample_id", "split")
    rows = s.tabular.drop("split").join(inner, "sample_id")
    fitted = fit_tabular_preprocessor(rows.filter("split = 'train_fit'"), columns)
    wide = transform_tabular(rows, fitted, columns)
    # Training passes over the rows many times.
    return materialize(wide.select("sample_id", "split", "target", "vector"), "vectors")


def _baselines(s: Stage) -> dict[str, DataFrame]:
    """Scores of both fitted baselines, and the rows they were fitted on."""

    def build() -> dict[str, DataFrame]:
        vectors = _vectors(s)
        models = {"linear": sc.fit_linear_baseline(vectors), "tree": sc.fit_tree_baseline(vectors, seed=SEED)}
        scores = {k: materialize(sc.score_table(m, vectors), f"{k}-scores") for k, m in models.items()}
        return {"vectors": vectors, **scores}

    return s.result("baselines", build)


@query("f3_fit_linear_baseline", weekly=True)
def _(s: Stage) -> DataFrame:
    return _baselines(s)["linear"]


@query("f3_fit_tree_baseline", weekly=True)
def _(s: Stage) -> DataFrame:
    return _baselines(s)["tree"]


@query(
    "f3_baseline_bounds",
    """SELECT model, true AS complete, true AS finite, true AS fit_beats_mean
    FROM (VALUES ('linear'), ('tree')) m(model) WHERE (SELECT count(*) FROM tabular) > 0""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    """Every row has a finite score, and on fitted rows no larger absolute or squared error than
    the best constant has."""
    found = _baselines(s)
    rows = found["vectors"].select("sample_id", "split", "target")
    fitted = F.col("split") == "train_fit"
    center = rows.filter(fitted).agg(F.avg("target").alias("mean"), F.percentile("target", 0.5).alias("median"))
    best = center.first()

    def judged(name: str) -> DataFrame:
        gap = F.col("target") - F.col("score_raw")
        error = {
            "linear": (F.abs(gap), F.abs(F.col("target") - best["median"])),
            "tree": (gap * gap, F.pow(F.col("target") - best["mean"], 2)),
        }[name]
        own, constant = (F.avg(F.when(fitted, e)) for e in error)
        score = F.col("score_raw")
        return rows.join(found[name], "sample_id", "left").agg(
            F.lit(name).alias("model"),
            (F.count("score_raw") == F.count("sample_id")).alias("complete"),
            F.bool_and(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).alias("finite"),
            (own <= constant * 1.01).alias("fit_beats_mean"),
        )

    return judged("linear").unionByName(judged("tree"))


@query(
    "f4_score_table",
    f"""SELECT sample_id, round6(coalesce(r_close__mean_20, 0) * 2 + coalesce(vol20__last, 0))
        AS score_raw FROM tabular""",
)
def _(s: Stage) -> DataFrame:
    def predict(batch):
        return batch["r_close__mean_20"].fillna(0.0) * 2 + batch["vol20__last"].fillna(0.0)

    return sc.score_with(s.tabular, predict, ["r_close__mean_20", "vol20__last"])
