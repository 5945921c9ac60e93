"""Queries on evaluation metrics and research statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.ranking import with_average_rank
from factorloom.operators import metrics as mt
from factorloom.operators import neutralize as nt
from factorloom.operators import quality as q
from factorloom.operators import research as rs
from factorloom.operators import statistics as st
from factorloom.operators.evaluation import evaluate_prediction_table
from factorloom.plans.ctes import book, book_mean, d, hac, ic, neutral, series
from factorloom.plans.queries_tables import two_runs
from factorloom.plans.registry import query
from factorloom.plans.stage import LINEAGE, SEEDS, Stage

NETS = ("net_0bps", "net_10bps", "net_20bps", "net_50bps")
BOOK = ("gross_q_high_minus_low", "turnover", *NETS)
MEANS = ("mean_turnover", "gross_q_high_minus_low", *NETS)
STATS = ("mean", "std", "ir", "positive_ratio")
PROTOCOL = rs.Protocol(hac_lags=3, stride=2, offset=1)
HAC = (3, 2, 1)


@query("g1_daily_ic", f"SELECT asof_date, n, {d('ic')} FROM ({ic('predictions')})")
def _(s: Stage) -> DataFrame:
    return mt.daily_ic(s.predictions).drop("rank_ic")


@query(
    "g2_average_rank",
    """SELECT security_id, asof_date, rank() OVER (PARTITION BY asof_date ORDER BY score_raw)
        + (count(*) OVER (PARTITION BY asof_date, score_raw) - 1) / 2.0 AS average_rank
    FROM predictions""",
)
def _(s: Stage) -> DataFrame:
    ranked = with_average_rank(s.predictions, "average_rank", "score_raw", ["asof_date"])
    return ranked.select("security_id", "asof_date", "average_rank")


@query("g3_daily_rank_ic", f"SELECT asof_date, n, {d('rank_ic')} FROM ({ic('predictions')})")
def _(s: Stage) -> DataFrame:
    return mt.daily_ic(s.predictions).drop("ic")


@query(
    "g4_aggregate_series",
    f"SELECT dates, {d(*STATS)} FROM ({series('(' + ic('predictions') + ')', 'rank_ic')})",
)
def _(s: Stage) -> DataFrame:
    return mt.aggregate_series(mt.daily_ic(s.predictions), "rank_ic")


@query(
    "g5_neutralize",
    f"""SELECT security_id, asof_date, {d('score_raw', 'score_neutralized')}
    FROM ({neutral('scored')})""",
)
def _(s: Stage) -> DataFrame:
    return nt.neutralize(s.predictions).select(
        "security_id", "asof_date", "score_raw", "score_neutralized"
    )


@query(
    "g5_neutralization_audit",
    """SELECT quality, count(*) AS dates, CAST(sum(rows) AS BIGINT) AS rows,
        CAST(sum(available) AS BIGINT) AS available_rows
    FROM (SELECT asof_date, count(*) AS rows, count(score_neutralized) AS available,
            CASE WHEN count(*) FILTER (complete) < 3
                THEN 'unavailable_missing_point_in_time_exposures'
                WHEN count(score_neutralized) = 0 THEN 'unavailable_insufficient_cross_section'
                ELSE 'industry_and_log_market_cap' END AS quality
          FROM predictions GROUP BY asof_date) GROUP BY quality""",
)
def _(s: Stage) -> DataFrame:
    return nt.neutralization_audit(s.predictions)


@query(
    "g6_quantile_portfolio",
    """SELECT asof_date, security_id, n, groups, round6(CASE WHEN i > n - k THEN 1.0 / k
        ELSE -1.0 / k END) AS weight
    FROM (SELECT *, least(5, n) AS groups, greatest(1, n // least(5, n)) AS k
        FROM (SELECT *, count(*) OVER (PARTITION BY asof_date) AS n,
                row_number() OVER (PARTITION BY asof_date ORDER BY score_raw, security_id) AS i
              FROM predictions))
    WHERE n >= 2 AND (i <= k OR i > n - k)""",
)
def _(s: Stage) -> DataFrame:
    return mt.portfolio_legs(s.predictions).select(
        "asof_date", "security_id", "n", "groups", "weight"
    )


@query("g7_turnover", f"SELECT asof_date, {d('turnover')} FROM ({book('predictions')})")
def _(s: Stage) -> DataFrame:
    return mt.daily_portfolio(s.predictions).select("asof_date", "turnover")


@query("g8_net_of_cost", f"SELECT asof_date, n, groups, {d(*BOOK)} FROM ({book('predictions')})")
def _(s: Stage) -> DataFrame:
    return mt.daily_portfolio(s.predictions)


@query(
    "g9_aggregate_portfolio",
    f"SELECT dates, {d(*MEANS)} FROM ({book_mean('(' + book('predictions') + ')')})",
)
def _(s: Stage) -> DataFrame:
    return mt.aggregate_portfolio(mt.daily_portfolio(s.predictions))


@query(
    "g10_cross_section_stats",
    """SELECT count(*) AS dates, min(n) AS minimum, median(n)::DOUBLE AS median,
        round6(avg(n)) AS mean, max(n) AS maximum, count(*) >= 20 AND median(n) >= 20
        AS research_ready
    FROM (SELECT asof_date, count(*) AS n FROM predictions GROUP BY asof_date)""",
)
def _(s: Stage) -> DataFrame:
    return mt.cross_section_stats(s.predictions)


_VALID = "(SELECT * FROM predictions WHERE split = 'valid')"


def _years(source: str) -> str:
    return f"(SELECT *, year(asof_date) AS year FROM {source})"


def _industries(source: str) -> str:
    return f"(SELECT * FROM {source} WHERE industry_code IS NOT NULL)"


def _sizes(source: str) -> str:
    return f"""(SELECT *, CASE ntile(3) OVER (PARTITION BY asof_date
        ORDER BY log_float_market_cap, security_id) WHEN 1 THEN 'small' WHEN 2 THEN 'mid'
        ELSE 'large' END AS size_bucket
    FROM {source} WHERE log_float_market_cap IS NOT NULL)"""


def _summary(source: str, by: str, key: str | None = None) -> str:
    """One row per group: both IC series and the portfolio means."""
    group = by + ", "
    daily, legs = f"({ic(source, group)})", f"({book(source, group)})"
    parts = []
    for name in ("ic", "rank_ic"):
        cols = ", ".join(
            f"round6({c}) AS {name}_{'positive' if c == 'positive_ratio' else c}"
            for c in STATS
        )
        parts.append(
            f"(SELECT {by}, dates AS {name}_dates, {cols} FROM ({series(daily, name, group)}))"
        )
    means = f"(SELECT {by}, dates AS portfolio_dates, {d(*MEANS)} FROM ({book_mean(legs, group)}))"
    return f"SELECT * {key or ''} FROM {parts[0]} JOIN {parts[1]} USING ({by}) LEFT JOIN {means} USING ({by})"


@query("g11_stability_by_year", _summary(_years("predictions"), "year", "REPLACE (CAST(year AS BIGINT) AS year)"))
def _(s: Stage) -> DataFrame:
    return mt.stability_by_year(s.predictions)


@query("g12_stability_by_industry", _summary(_industries("predictions"), "industry_code"))
def _(s: Stage) -> DataFrame:
    return mt.stability_by_industry(s.predictions)


@query("g13_stability_by_size", _summary(_sizes("predictions"), "size_bucket"))
def _(s: Stage) -> DataFrame:
    return mt.stability_by_size(s.predictions)


def _scores(statement) -> str:
    """The statement for the raw and for the neutralized score."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS score, * FROM ({statement(f'score_{name}')})" for name in ("raw", "neutralized")
    )


def _ic_rows(source: str):
    return lambda score: " UNION ALL ".join(
        f"SELECT '{v}' AS series, dates, {d(*STATS)} FROM ({series('(' + ic(source, score=score) + ')', v)})"
        for v in ("ic", "rank_ic")
    )


def _evaluation_sql(source: str) -> dict[str, str]:
    """Every table of an evaluation, by name."""

    def legs(score: str) -> str:
        return book(source, score=score)

    return {
        "ic": _scores(_ic_rows(source)),
        "daily_ic": _scores(
            lambda score: f"SELECT asof_date, n, {d('ic', 'rank_ic')} FROM ({ic(source, score=score)})"
        ),
        "daily_portfolio": _scores(
            lambda score: f"SELECT asof_date, n, groups, {d(*BOOK)} FROM ({legs(score)})"
        ),
        "portfolio": _scores(
            lambda score: f"SELECT dates, {d(*MEANS)} FROM ({book_mean('(' + legs(score) + ')')})"
        ),
        "by_year": _summary(_years(source), "year", "REPLACE (CAST(year AS BIGINT) AS year)"),
        "by_industry": _summary(_industries(source), "industry_code"),
        "by_size": _summary(_sizes(source), "size_bucket"),
    }


def _register(prefix: str, main: str, statements: dict[str, str], tables, weekly: bool = False) -> None:
    """One query for each result table; ``main`` has the plain name."""
    for name, sql in statements.items():
        query(prefix if name == main else f"{prefix}_{name}", sql, weekly=weekly)(lambda s, n=name: tables(s)[n])


def _evaluated(s: Stage) -> dict[str, DataFrame]:
    return s.result("evaluated", lambda: mt.evaluate_predictions(s.predictions))


_CROSS_SECTION = """SELECT count(*) AS dates, min(n) AS minimum, median(n)::DOUBLE AS median,
        round6(avg(n)) AS mean, max(n) AS maximum"""

_register(
    "g14_evaluate_predictions",
    "ic",
    {
        **_evaluation_sql("predictions"),
        "cross_section": f"""{_CROSS_SECTION}, count(*) >= 20 AND median(n) >= 20 AS research_ready
            FROM (SELECT asof_date, count(*) AS n FROM predictions GROUP BY asof_date)""",
    },
    _evaluated,
)


def _judged(s: Stage) -> dict[str, DataFrame]:
    """The valid rows against the index; the source is ready in one case and not in the other."""

    def build() -> dict[str, DataFrame]:
        valid, dataset = s.predictions.filter("split = 'valid'"), LINEAGE["dataset_id"]
        tables = evaluate_prediction_table(valid, s.samples, dataset, source_ready=False)
        ready = mt.cross_section_stats(s.predictions)
        gate = q.readiness_gate(F.col("research_ready"), F.lit(True))
        tables["ready_case"] = ready.select("dates", gate.alias("research_ready"))
        return tables

    return s.result("judged", build)


_register(
    "g15_evaluate_prediction_table",
    "cross_section",
    {
        **_evaluation_sql(_VALID),
        "cross_section": f"""{_CROSS_SECTION}, false AS research_ready,
            count(*) >= 20 AND median(n) >= 20 AS statistical_ready, false AS source_research_ready
            FROM (SELECT asof_date, count(*) AS n FROM {_VALID} GROUP BY asof_date)""",
        "coverage": """SELECT 'valid' AS split, count(*) AS expected_rows, count(*) AS prediction_rows,
            CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS unexpected_rows,
            1.0::DOUBLE AS coverage, 1.0::DOUBLE AS minimum_required, true AS passed
            FROM samples WHERE split = 'valid'""",
        "ready_case": """SELECT count(*) AS dates, count(*) >= 20 AND median(n) >= 20 AS research_ready
            FROM (SELECT asof_date, count(*) AS n FROM predictions GROUP BY asof_date)""",
    },
    _judged,
)


_RUNS = f"""(SELECT 'forward' AS run_id, * FROM {_VALID}
    UNION ALL SELECT 'backward', * REPLACE (-score_raw AS score_raw,
        -score_neutralized AS score_neutralized) FROM {_VALID})"""


@query(
    "g16_compare_runs",
    f"""SELECT run_id, 'momentum' AS model_id, 1.0::DOUBLE AS coverage, a.mean_ic, b.mean_rank_ic,
        b.rank_icir, p.gross_q_high_minus_low, p.mean_turnover, z.neutralized_mean_rank_ic,
        (SELECT count(*) >= 20 AND median(c) >= 20
            FROM (SELECT count(*) AS c FROM {_VALID} GROUP BY asof_date)) AS research_ready
    FROM (SELECT run_id, round6(mean) AS mean_ic
            FROM ({series('(' + ic(_RUNS, 'run_id, ') + ')', 'ic', 'run_id, ')})) a
    JOIN (SELECT run_id, round6(mean) AS mean_rank_ic, round6(ir) AS rank_icir
            FROM ({series('(' + ic(_RUNS, 'run_id, ') + ')', 'rank_ic', 'run_id, ')})) b USING (run_id)
    JOIN (SELECT run_id, {d('gross_q_high_minus_low', 'mean_turnover')}
            FROM ({book_mean('(' + book(_RUNS, 'run_id, ') + ')', 'run_id, ')})) p USING (run_id)
    JOIN (SELECT run_id, round6(mean) AS neutralized_mean_rank_ic
            FROM ({series('(' + ic(_RUNS, 'run_id, ', 'score_neutralized') + ')', 'rank_ic', 'run_id, ')})
         ) z USING (run_id)""",
)
def _(s: Stage) -> DataFrame:
    expected = s.samples.filter("split = 'valid'").agg(F.count(F.lit(1)).alias("expected_rows"))
    expected = expected.withColumn("dataset_id", F.lit(LINEAGE["dataset_id"]))
    return mt.compare_runs(two_runs(s).filter("split = 'valid'"), expected)


# Research statistics over the fold x seed x model matrix

INFERENCE = ("mean", "standard_error", "t_stat")
STRIDED = tuple(f"non_overlapping_{c}" for c in INFERENCE)
_SINGLE = "(SELECT *, 0 AS one FROM cell_daily)"
CELL = ["fold_id", "seed", "model_key", "metric"]
_CELL = "fold_id, seed, model_key, metric, "


@query(
    "h1_newey_west_mean",
    f"SELECT {_CELL} n, {d(*INFERENCE)}, lags FROM ({hac(_SINGLE, *HAC, _CELL, 'one')})",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return st.newey_west_mean(s.cell_daily, lags=3, by=CELL)


_STRIDE = f"""(SELECT {_CELL} count(v) AS n, avg(v) AS mean,
        CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) END AS standard_error
    FROM (SELECT *, CASE WHEN pos >= 1 AND (pos - 1) % 2 = 0 THEN value END AS v
          FROM (SELECT *, row_number() OVER (PARTITION BY {_CELL.rstrip(', ')} ORDER BY asof_date) - 1
                AS pos FROM cell_daily))
    GROUP BY ALL)"""
_STRIDE_T = "CASE WHEN standard_error > 0 THEN mean / standard_error END"


@query(
    "h2_non_overlapping_mean",
    f"""SELECT {_CELL} n, {d('mean', 'standard_error')}, round6({_STRIDE_T}) AS t_stat
    FROM {_STRIDE}""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return st.non_overlapping_mean(s.cell_daily, stride=2, offset=1, by=CELL)


@query(
    "h3_series_inference",
    f"""SELECT {_CELL} h.n, {', '.join(f'round6(h.{c}) AS {c}' for c in INFERENCE)}, h.lags,
        o.n AS non_overlapping_n, round6(o.mean) AS non_overlapping_mean,
        round6(o.standard_error) AS non_overlapping_standard_error,
        round6(CASE WHEN o.standard_error > 0 THEN o.mean / o.standard_error END)
            AS non_overlapping_t_stat
    FROM ({hac(_SINGLE, *HAC, _CELL, 'one')}) h JOIN {_STRIDE} o USING ({_CELL.rstrip(', ')})""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return st.series_inference(s.cell_daily, lags=3, stride=2, offset=1, by=CELL)


_GROUP = "seed, model_key, metric, "


@query(
    "h4_panel_mean_inference",
    f"""SELECT {_GROUP} n, {d(*INFERENCE)}, lags, non_overlapping_n, {d(*STRIDED)}
    FROM ({hac('cell_daily', *HAC, _GROUP, 'fold_id')})""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return st.panel_mean_inference(
        s.cell_daily, lags=3, stride=2, offset=1, by=["seed", "model_key", "metric"]
    )


_SEEDS = """(SELECT model_key, metric, fold_id, asof_date, avg(value) AS value FROM cell_daily
    WHERE value IS NOT NULL GROUP BY ALL)"""


@query("h5_seed_average", f"SELECT model_key, metric, fold_id, asof_date, {d('value')} FROM {_SEEDS}", weekly=True)
def _(s: Stage) -> DataFrame:
    return rs.seed_average(s.cell_daily)


_PAIRS = ", ".join(f"('{name}', '{a}', '{b}')" for name, (a, b) in rs.PAIRED_COMPARISONS.items())
_DAYS = f"""(SELECT comparison, fold_id, seed, asof_date, l.value - r.value AS value
    FROM (VALUES {_PAIRS}) p(comparison, lhs, rhs)
    JOIN (SELECT * FROM cell_daily WHERE metric = 'raw_rank_ic' AND value IS NOT NULL) l
        ON l.model_key = p.lhs
    JOIN (SELECT fold_id, seed, model_key, asof_date, value FROM cell_daily
          WHERE metric = 'raw_rank_ic' AND value IS NOT NULL) r
        USING (fold_id, seed, asof_date) WHERE r.model_key = p.rhs)"""
_SHARES = f"""(SELECT comparison, count(*) AS cell_count,
        avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS positive_cell_ratio
    FROM (SELECT comparison, fold_id, seed, avg(value) AS m FROM {_DAYS} GROUP BY ALL)
    GROUP BY comparison)"""
_DELTA_DAYS = f"""(SELECT comparison, fold_id, asof_date, avg(value) AS value FROM {_DAYS}
    GROUP BY ALL)"""
_DELTAS = f"""(SELECT * FROM {_SHARES} JOIN ({hac(_DELTA_DAYS, *HAC, 'comparison, ', 'fold_id')})
    USING (comparison))"""


@query(
    "h6_paired_delta",
    f"""SELECT comparison, cell_count, {d('positive_cell_ratio')}, n, {d(*INFERENCE)}, lags,
        non_overlapping_n, {d(*STRIDED)} FROM {_DELTAS}""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return rs.paired_delta(s.cell_daily, PROTOCOL)


_REASONS = """concat_ws('; ',
        CASE WHEN NOT coalesce(mean > 0, false) THEN 'paired mean Rank IC delta is not positive' END,
        CASE WHEN positive_cell_ratio < 0.5
            THEN 'positive fold/seed cell ratio is below the configured threshold' END)"""


@query(
    "h7_decide",
    f"""SELECT comparison, {_REASONS} = '' AS passed,
        CASE WHEN {_REASONS} = '' THEN 'go' ELSE 'no_go' END AS status, {_REASONS} AS reasons,
        round6(mean) AS mean_delta, {d('positive_cell_ratio')},
        0.5::DOUBLE AS minimum_positive_cell_ratio FROM {_DELTAS}""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    decided = rs.decide(rs.paired_delta(s.cell_daily, PROTOCOL), F.lit(False), PROTOCOL)
    return decided.withColumn("reasons", F.array_join("reasons", "; "))


_MODELS = f"({hac(_SEEDS, *HAC, 'model_key, metric, ', 'fold_id')})"
_OVERALL = f"""(SELECT (SELECT mean FROM {_MODELS} WHERE model_key = 'e3' AND metric = 'raw_rank_ic')
        AS raw_rank_ic_mean,
        (SELECT mean FROM {_MODELS} WHERE model_key = 'e3' AND metric = 'neutralized_rank_ic')
        AS neutralized_rank_ic_mean,
        (SELECT mean FROM {_MODELS} WHERE model_key = 'e3' AND metric = 'net_20bps') AS net_20bps_mean,
        (SELECT positive_cell_ratio FROM {_SHARES} WHERE comparison = 'overall_e3_vs_e1')
        AS e3_vs_e1_positive_cell_ratio)"""
_CRITERIA = """concat_ws('; ',
        CASE WHEN NOT coalesce(raw_rank_ic_mean > 0, false) THEN 'E3 raw Rank IC is not positive' END,
        CASE WHEN NOT coalesce(neutralized_rank_ic_mean > 0, false)
            THEN 'E3 neutralized Rank IC is unavailable or not positive' END,
        CASE WHEN NOT coalesce(net_20bps_mean > 0, false)
            THEN 'E3 net Q5-Q1 at 20 bps is not positive' END,
        CASE WHEN e3_vs_e1_positive_cell_ratio < 0.5
            THEN 'E3 does not beat E1 in enough fold/seed cells' END)"""
_SOURCE = "'source provenance is missing or not explicitly research-ready'"
_OVERALL_REASONS = f"concat_ws('; ', nullif({_CRITERIA}, ''), {_SOURCE})"


@query(
    "h8_overall_decision",
    f"""SELECT {d('raw_rank_ic_mean', 'neutralized_rank_ic_mean', 'net_20bps_mean',
                 'e3_vs_e1_positive_cell_ratio')},
        {_OVERALL_REASONS} AS reasons, false AS passed, 'no_go' AS status FROM {_OVERALL}""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    verdict = rs.overall_decision(
        rs.model_inference(s.cell_daily, PROTOCOL),
        rs.paired_delta(s.cell_daily, PROTOCOL),
        F.lit(True),
        PROTOCOL,
    )
    return verdict.withColumn("reasons", F.array_join("reasons", "; "))


def _aggregated(s: Stage) -> dict[str, DataFrame]:
    return s.result(
        "aggregated",
        lambda: rs.aggregate_research(
            s.cells,
            s.cell_daily,
            folds=[f.fold_id for f in s.layout.folds],
            seeds=SEEDS,
            protocol=PROTOCOL,
            predictions=s.cell_predictions,
            split="valid",
        ),
    )


# A fold's source counts as ready with enough valid dates and names.
_READY = """(SELECT fold_id, count(*) >= 20 AND median(n) >= 20 AS ready
    FROM (SELECT fold_id, asof_date, count(*) AS n FROM fold_samples WHERE split = 'valid' GROUP BY ALL)
    GROUP BY fold_id)"""
_GATE = f"(SELECT NOT bool_and(ready) FROM {_READY})"
_GATED = f"concat_ws('; ', nullif({_REASONS}, ''), CASE WHEN {_GATE} THEN {_SOURCE} END)"
_GATED_OVERALL = f"concat_ws('; ', nullif({_CRITERIA}, ''), CASE WHEN {_GATE} THEN {_SOURCE} END)"

_register(
    "h9_aggregate_research",
    "models",
    {
        "models": f"""SELECT model_key, metric, n, {d(*INFERENCE)}, lags, non_overlapping_n,
            {d(*STRIDED)} FROM {_MODELS}""",
        "paired_deltas": f"""SELECT comparison, cell_count, {d('positive_cell_ratio')}, n,
            {d(*INFERENCE)}, lags, non_overlapping_n, {d(*STRIDED)} FROM {_DELTAS}""",
        "decisions": f"""SELECT comparison, {_GATED} = '' AS passed,
            CASE WHEN {_GATED} = '' THEN 'go' ELSE 'no_go' END AS status, {_GATED} AS reasons,
            round6(mean) AS mean_delta, {d('positive_cell_ratio')},
            0.5::DOUBLE AS minimum_positive_cell_ratio FROM {_DELTAS}
            WHERE comparison <> '{rs.OVERALL}'""",
        "overall": f"""SELECT {d('raw_rank_ic_mean', 'neutralized_rank_ic_mean', 'net_20bps_mean',
            'e3_vs_e1_positive_cell_ratio')}, {_GATED_OVERALL} AS reasons,
            {_GATED_OVERALL} = '' AS passed,
            CASE WHEN {_GATED_OVERALL} = '' THEN 'go' ELSE 'no_go' END AS status FROM {_OVERALL}""",
        "source_readiness": f"""SELECT bool_and(ready) AS all_cells_explicitly_ready,
            bool_or(NOT ready) AS explicitly_blocked, NOT bool_and(ready) AS gate_failed FROM {_READY}""",
    },
    lambda s: {
        name: frame.withColumn("reasons", F.array_join("reasons", "; "))
        if "reasons" in frame.columns
        else frame
        for name, frame in _aggregated(s).items()
    },
    weekly=True,
)


# The end-to-end flagship

_FLAGSHIP = f"SELECT asof_date, n, {d('ic', 'rank_ic')} FROM ({ic('predictions')})"


@query("flagship_daily_ic", _FLAGSHIP)
def flagship(s: Stage) -> DataFrame:
    """Bars, grid, features, labels, split, score, neutralisation and daily IC."""
    return mt.daily_ic(s.predictions)
