"""The stage tables stated again as plain SQL, to check the Spark plans against.

``with_tables(sql)`` puts the common table expressions a statement needs in front of it.
"""

from __future__ import annotations

import re
from functools import cache

from factorloom.functions.columns import CHANNELS
from factorloom.plans.stage import HORIZON, LAG, MONTHS, SEEDS, UNIVERSE_RULES, Layout


# Compared doubles lie on a grid of 1e-6 whose cell borders avoid decimal ties, which the
# engines' own round() breaks differently.
BORDER = 0.5003


def d(*names: str) -> str:
    return ", ".join(f"round6({n}) AS {n}" for n in names)


def expand_rounding(sql: str) -> str:
    """Spell out the shorthands round6(x) and round4(x)."""
    found = re.search(r"\bround([46])\(", sql)
    if not found:
        return sql
    depth, end = 1, found.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    inner, scale = sql[found.end() : end - 1], f"1e{found[1]}"
    spelled = f"floor(({inner}) * {scale} + {BORDER}) / {scale}"
    return sql[: found.start()] + expand_rounding(spelled + sql[end:])


def n(*names: str) -> str:
    return ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in names)


def ln_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"


def corr(x: str, y: str) -> str:
    return (
        f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) "
        f"THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"
    )


def rank_corr(x: str, y: str) -> str:
    """Sums of half-integer ranks are exact, so a zero correlation is exactly zero."""

    def cross(a: str, b: str) -> str:
        return f"(sum({a} * {b}) - sum({a}) * sum({b}) / count(*))"

    return (
        f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) "
        f"THEN {cross(x, y)} / sqrt({cross(x, x)} * {cross(y, y)}) END"
    )


def split_case(bounds: str = "") -> str:
    b = bounds
    return f"""CASE WHEN label_end <= {b}train_end THEN 'train'
        WHEN asof_date >= {b}valid_start AND label_end <= {b}valid_end THEN 'valid'
        WHEN asof_date >= {b}test_start AND label_end <= {b}test_end THEN 'test' END"""


def fold_rows(folds) -> str:
    rows = ", ".join(
        f"('{f.fold_id}', DATE '{f.train_end}', DATE '{f.valid_end}', DATE '{f.test_end}', "
        f"{f.embargo_sessions})"
        for f in folds
    )
    return f"(VALUES {rows}) AS f(fold_id, train_end, valid_end, test_end, embargo)"


def fold_bounds(folds) -> str:
    def later(boundary: str) -> str:
        return (
            "(SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) "
            f"AS i FROM (SELECT DISTINCT trade_date FROM universe) WHERE trade_date > f.{boundary}) "
            "WHERE i = f.embargo + 1)"
        )

    return (
        f"SELECT f.*, {later('train_end')} AS valid_start, {later('valid_end')} AS test_start "
        f"FROM {fold_rows(folds)}"
    )


def neutral(source: str, by: str = "") -> str:
    """Residuals of the per-date regression on industry and log-cap, by demeaning."""
    part = f"{by}asof_date"
    return f"""
    SELECT s.*, CASE WHEN s.complete AND r.rows >= 3 AND r.rows > r.industries + r.varies
            AND (r.varies = 0 OR r.sxx > 1e-12 * r.total)
        THEN s.ds - CASE WHEN r.varies = 1 THEN r.sxy / r.sxx ELSE 0 END * s.dc
        END AS score_neutralized
    FROM (SELECT *,
            score_raw - avg(score_raw) OVER (PARTITION BY {part}, industry_code, complete) AS ds,
            log_float_market_cap
              - avg(log_float_market_cap) OVER (PARTITION BY {part}, industry_code, complete) AS dc
          FROM (SELECT *, industry_code IS NOT NULL AND log_float_market_cap IS NOT NULL AS complete
                FROM {source})) s
    LEFT JOIN (
        SELECT {part}, count(*) AS rows, count(DISTINCT industry_code) AS industries,
            CASE WHEN max(log_float_market_cap) > min(log_float_market_cap) THEN 1 ELSE 0 END AS varies,
            sum(ds * dc) AS sxy, sum(dc * dc) AS sxx,
            var_pop(log_float_market_cap) * count(*) AS total
        FROM (SELECT *,
                score_raw - avg(score_raw) OVER (PARTITION BY {part}, industry_code) AS ds,
                log_float_market_cap
                  - avg(log_float_market_cap) OVER (PARTITION BY {part}, industry_code) AS dc
              FROM {source}
              WHERE industry_code IS NOT NULL AND log_float_market_cap IS NOT NULL)
        GROUP BY {part}) r USING ({part})"""


def ic(source: str, by: str = "", score: str = "score_raw") -> str:
    part = f"{by}asof_date"
    return f"""
    SELECT {part}, count(*) AS n, {corr(score, 'target')} AS ic, {rank_corr('rs', 'rt')} AS rank_ic
    FROM (SELECT *,
            rank() OVER (PARTITION BY {part} ORDER BY {score})
              + (count(*) OVER (PARTITION BY {part}, {score}) - 1) / 2.0::DOUBLE AS rs,
            rank() OVER (PARTITION BY {part} ORDER BY target)
              + (count(*) OVER (PARTITION BY {part}, target) - 1) / 2.0::DOUBLE AS rt
          FROM {source} WHERE {score} IS NOT NULL)
    GROUP BY {part}"""


def book(source: str, by: str = "", score: str = "score_raw", costs=(0, 10, 20, 50)) -> str:
    """Quantile spread, turnover against the previous usable date, net of costs."""
    part = f"{by}asof_date"
    cols = [c for c in by.replace(" ", "").split(",") if c]
    same = "".join(f" AND a.{c} = b.{c}" for c in cols)
    keys = "".join(f"coalesce(a.{c}, b.{c}) AS {c}, " for c in cols)
    nets = ", ".join(
        f"spread - coalesce(turnover, 0) * {c} / 10000.0 AS net_{c}bps" for c in costs
    )
    ranked = f"""(SELECT *, least(5, n) AS groups, greatest(1, n // least(5, n)) AS k
        FROM (SELECT {part}, security_id, target,
                row_number() OVER (PARTITION BY {part} ORDER BY {score}, security_id) AS i,
                count(*) OVER (PARTITION BY {part}) AS n
              FROM {source} WHERE {score} IS NOT NULL) WHERE n >= 2)"""
    legs = f"""(SELECT *, CASE WHEN i > n - k THEN 1.0 / k ELSE -1.0 / k END AS w,
            dense_rank() OVER ({'PARTITION BY ' + by.strip().rstrip(',') if cols else ''}
                               ORDER BY asof_date) AS seq
        FROM {ranked} WHERE i <= k OR i > n - k)"""
    return f"""
    SELECT {part}, n, groups, spread AS gross_q_high_minus_low, turnover, {nets}
    FROM (SELECT {part}, seq, max(n) AS n, max(groups) AS groups,
            avg(target) FILTER (i > n - k) - avg(target) FILTER (i <= k) AS spread
          FROM {legs} GROUP BY {part}, seq)
    LEFT JOIN (
        SELECT {by}seq, 0.5 * sum(abs(w)) AS turnover
        FROM (SELECT {keys} coalesce(a.seq, b.seq + 1) AS seq,
                coalesce(a.w, 0) - coalesce(b.w, 0) AS w
              FROM {legs} a FULL JOIN {legs} b
                ON a.security_id = b.security_id AND a.seq = b.seq + 1{same})
        WHERE seq > 1 GROUP BY {by}seq) USING ({by}seq)"""


def series(source: str, value: str, by: str = "") -> str:
    """Dates, mean, deviation, annualised ratio and positive share of one daily series."""
    group = f"GROUP BY {by.strip().rstrip(',')}" if by else ""
    return f"""
    SELECT {by} dates, mean, std, CASE WHEN std > 0 THEN mean / std * sqrt(252.0) END AS ir,
        positive_ratio
    FROM (SELECT {by} count({value}) AS dates, avg({value}) AS mean,
            CASE WHEN count({value}) > 1 THEN stddev_samp({value})
                 WHEN count({value}) = 1 THEN 0.0 END AS std,
            avg(CASE WHEN {value} > 0 THEN 1.0 WHEN {value} <= 0 THEN 0.0 END) AS positive_ratio
          FROM {source} {group})"""


def book_mean(source: str, by: str = "", costs=(0, 10, 20, 50)) -> str:
    group = f"GROUP BY {by.strip().rstrip(',')}" if by else ""
    nets = ", ".join(f"avg(net_{c}bps) AS net_{c}bps" for c in costs)
    return f"""SELECT {by} count(*) AS dates, avg(turnover) AS mean_turnover,
        avg(gross_q_high_minus_low) AS gross_q_high_minus_low, {nets} FROM {source} {group}"""


def hac(source: str, lags: int, stride: int, offset: int, by: str, fold: str) -> str:
    """Pooled mean with HAC error and the per-fold strided mean."""
    part = by.strip().rstrip(",")
    over = f"PARTITION BY {by}{fold}"
    products = "".join(
        f", x * lag(x, {k}) OVER ({over} ORDER BY asof_date) AS p{k}" for k in range(1, lags + 1)
    )
    sums = "".join(f", coalesce(sum(p{k}), 0) AS s{k}" for k in range(1, lags + 1))
    used = f"least({lags}, longest - 1)"
    terms = "".join(
        f" + CASE WHEN {used} >= {k} THEN 2 * (1 - {k} / ({used} + 1.0)) * s{k} ELSE 0 END"
        for k in range(1, lags + 1)
    )
    found = f"""
    SELECT {by} n, mean, se AS standard_error, CASE WHEN se > 0 THEN mean / se END AS t_stat,
        CASE WHEN n = 1 THEN 0 ELSE {used} END AS lags,
        m AS non_overlapping_n, sm AS non_overlapping_mean, sse AS non_overlapping_standard_error,
        CASE WHEN sse > 0 THEN sm / sse END AS non_overlapping_t_stat
    FROM (SELECT *, CASE WHEN n > 1 THEN sqrt(greatest((s0{terms}) / n, 0) / n) END AS se,
              CASE WHEN m > 1 THEN ssd / sqrt(m) END AS sse
        FROM (SELECT {by} count(*) AS n, avg(value) AS mean, max(fold_n) AS longest,
                  sum(x * x) AS s0 {sums}, count(picked) AS m, avg(picked) AS sm,
                  stddev_samp(picked) AS ssd
            FROM (SELECT *, CASE WHEN pos >= {offset} AND (pos - {offset}) % {stride} = 0
                            THEN value END AS picked {products}
                FROM (SELECT *, value - avg(value) OVER ({'PARTITION BY ' + part if part else ''}) AS x,
                        count(*) OVER ({over}) AS fold_n,
                        row_number() OVER ({over} ORDER BY asof_date) - 1 AS pos
                    FROM {source} WHERE value IS NOT NULL))
            {'GROUP BY ' + part if part else ''}))"""
    if not part:
        return found
    # A group without a value has no rows to average, but is still a group.
    return f"""
    SELECT {by} coalesce(n, 0) AS n, mean, standard_error, t_stat, coalesce(lags, {lags}) AS lags,
        coalesce(non_overlapping_n, 0) AS non_overlapping_n, non_overlapping_mean,
        non_overlapping_standard_error, non_overlapping_t_stat
    FROM (SELECT DISTINCT {part} FROM {source}) LEFT JOIN ({found}) USING ({part})"""


def _rolled(c: str, windows) -> str:
    parts = [f"{c} AS {c}__last"]
    for w in windows:
        for stat, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
            parts.append(
                f"CASE WHEN count({c}) OVER w{w} = {w} THEN {fn}({c}) OVER w{w} END "
                f"AS {c}__{stat}_{w}"
            )
    return ", ".join(parts)


def _model_score(model: str, weights) -> str:
    base = " + ".join(f"{w} * coalesce({f}, 0)" for f, w in weights)
    offset = "CAST(substring(security_id, 5) AS BIGINT) * seed % 1009 / 1009.0 * 0.5"
    return f"WHEN model_key = '{model}' THEN round(0.0 + {base} + {offset}, 9)"


_scaled = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN (least(greatest({c}, "
    f"(SELECT lo FROM scaler WHERE channel = '{c}')), (SELECT hi FROM scaler WHERE channel = '{c}'))"
    f" - (SELECT median FROM scaler WHERE channel = '{c}'))"
    f" / (SELECT scale FROM scaler WHERE channel = '{c}') END AS {c}"
    for c in CHANNELS
)
_flags = ", ".join(f"{c} IS NOT NULL AS observed_{c}" for c in CHANNELS)
_w = "PARTITION BY security_id ORDER BY trade_date"

@cache
def table_sql(layout: Layout) -> dict[str, str]:
    """Every stage table of a layout by name, each before those that read it."""
    frames = ", ".join(
        f"w{w} AS (PARTITION BY security_id ORDER BY trade_date ROWS {w - 1} PRECEDING)" for w in layout.windows
    )

    def security(supplier: str) -> str:
        return supplier if layout.suppliers == 1 else f"(({supplier} - 1) // {layout.suppliers})"

    return {
        "li": f"""
            SELECT {security('l_suppkey')} AS k, CAST(date_trunc('{layout.period}', l_shipdate) AS DATE) AS trade_date,
                l_extendedprice / nullif(l_quantity, 0) AS p, l_quantity AS q, l_extendedprice AS e,
                l_discount AS d,
                row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS o
            FROM lineitem
            WHERE NOT ({security('l_suppkey')} % 10 = 9 AND l_shipdate >= TIMESTAMP '2000-01-01')""",
        "bars": """
            SELECT 'sec:' || k AS security_id, 'S' || k AS symbol, trade_date, arg_min(p, o) AS open,
                max(p) AS high, min(p) AS low, arg_max(p, o) AS close, sum(q) AS volume,
                sum(e) AS dollar_volume, 1 - avg(d) AS adj_factor, 'tpch' AS source_revision,
                CASE k % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' ELSE 'AMEX' END AS exchange_source,
                CASE WHEN k % 17 = 0 THEN 'ETF' ELSE 'Common Stock' END AS security_type_source,
                'provider_symbol_fallback' AS identity_quality, 'S' || k || '.US' AS provider_symbol,
                k % 10 = 9 AS is_delisted_source
            FROM li GROUP BY k, trade_date""",
        "cal": """
            SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_session
            FROM (SELECT DISTINCT trade_date FROM bars)""",
        "ranges": """
            SELECT r.*, CASE WHEN eventually_delisted THEN coalesce(next_session, last_trade_date)
                ELSE (SELECT max(trade_date) FROM cal) END AS range_end
            FROM (SELECT security_id, min(trade_date) AS first_trade_date,
                    max(trade_date) AS last_trade_date, bool_or(is_delisted_source) AS eventually_delisted,
                    arg_min(exchange_source, trade_date) AS exchange_source,
                    arg_min(security_type_source, trade_date) AS security_type_source,
                    arg_min(symbol, trade_date) AS fallback_symbol,
                    arg_min(identity_quality, trade_date) AS identity_quality,
                    arg_min(provider_symbol, trade_date) AS provider_symbol
                  FROM bars GROUP BY security_id) r
            LEFT JOIN cal ON cal.trade_date = r.last_trade_date""",
        "grid": """
            SELECT r.*, c.trade_date FROM ranges r
            JOIN cal c ON c.trade_date BETWEEN r.first_trade_date AND r.range_end""",
        "observed": f"""
            SELECT g.*, b.close, b.dollar_volume,
                coalesce(last_value(b.symbol IGNORE NULLS) OVER (PARTITION BY g.security_id
                    ORDER BY g.trade_date), g.fallback_symbol) AS symbol,
                CASE WHEN count(b.dollar_volume) OVER w20 = 20 THEN avg(b.dollar_volume) OVER w20 END
                    AS adv20_usd,
                row_number() OVER (PARTITION BY g.security_id ORDER BY g.trade_date) AS listed_days
            FROM grid g LEFT JOIN bars b USING (security_id, trade_date)
            WINDOW w20 AS (PARTITION BY g.security_id ORDER BY g.trade_date ROWS 19 PRECEDING)""",
        "states": """
            SELECT *, true AS is_primary_listing,
                NOT (eventually_delisted AND trade_date > last_trade_date) AS is_listed,
                eventually_delisted AND trade_date > last_trade_date AS is_delisted,
                NOT (eventually_delisted AND trade_date > last_trade_date) AND close IS NULL AS is_halted,
                CASE WHEN close IS NOT NULL THEN 'observed_bar'
                     WHEN eventually_delisted AND trade_date > last_trade_date
                     THEN 'imputed_delisted_session' ELSE 'missing_bar_assumed_halt'
                     END AS trade_status_quality,
                CASE exchange_source WHEN 'NASDAQ' THEN 'XNAS' WHEN 'NYSE' THEN 'XNYS'
                    WHEN 'AMEX' THEN 'XASE' END AS exchange,
                CASE security_type_source WHEN 'Common Stock' THEN 'common_stock' ELSE 'etf' END
                    AS security_type
            FROM observed""",
        "candidates": f"""
            SELECT *, coalesce(security_type = 'common_stock'
                AND listed_days >= {UNIVERSE_RULES['min_listed_sessions']}
                AND close >= {UNIVERSE_RULES['min_price']}
                AND adv20_usd >= {UNIVERSE_RULES['min_adv20_usd']}
                AND is_listed AND NOT is_halted, false) AS eligible
            FROM states""",
        "exposures": f"""
            SELECT 'sec:' || {security('s_suppkey')} AS security_id, r_name AS industry_code,
                s_acctbal AS float_market_cap
            FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
            LEFT JOIN region ON n_regionkey = r_regionkey
            WHERE (s_suppkey - 1) % {layout.suppliers} = 0""",
        "universe": "SELECT * FROM candidates LEFT JOIN exposures USING (security_id)",
        "delistings": """
            SELECT l.security_id, u.delist_date, l.last_trade_date,
                CASE u.exchange WHEN 'XNAS' THEN -0.55 WHEN 'XNYS' THEN -0.30 WHEN 'XASE' THEN -0.30
                    ELSE -0.50 END::DOUBLE AS delisting_return,
                CAST(NULL AS DOUBLE) AS terminal_value, u.delist_date AS known_at,
                'tpch' AS source_revision, true AS is_imputed,
                'exchange_penalty:' || u.exchange AS imputation_method, u.exchange
            FROM (SELECT security_id, max(trade_date) AS last_trade_date FROM bars
                  WHERE is_delisted_source GROUP BY security_id) l
            JOIN (SELECT security_id, min(trade_date) AS delist_date, min(exchange) AS exchange
                  FROM universe WHERE is_delisted GROUP BY security_id) u USING (security_id)""",
        "panel": """
            SELECT u.security_id, u.symbol, u.trade_date, open * adj_factor AS ao, high * adj_factor AS ah,
                low * adj_factor AS al, b.close * adj_factor AS ac, volume, b.dollar_volume
            FROM universe u LEFT JOIN bars b USING (security_id, trade_date)""",
        "returns": f"""
            SELECT *, {ln_ratio('ac', 'pc')} AS r_close, {ln_ratio('ao', 'pc')} AS r_gap,
                {ln_ratio('ac', 'ao')} AS r_intraday, {ln_ratio('ah', 'al')} AS range,
                lv - plv AS dlog_volume,
                CASE WHEN size = 20 THEN (dollar_volume - (w[10] + w[11]) / 2) * 1.349
                    / nullif(w[15] - w[6], 0) END AS dollar_volume_z20
            FROM (SELECT *, lag(ac) OVER ({_w}) AS pc,
                    CASE WHEN volume > -1 THEN ln(1 + volume) END AS lv,
                    lag(CASE WHEN volume > -1 THEN ln(1 + volume) END) OVER ({_w}) AS plv,
                    count(dollar_volume) OVER w20 AS size,
                    list_sort(list(dollar_volume) OVER w20) AS w
                  FROM panel WINDOW w20 AS ({_w} ROWS 19 PRECEDING))""",
        "raw_features": f"""
            SELECT security_id, symbol, trade_date, {', '.join(CHANNELS)}, {_flags}
            FROM (SELECT *, CASE WHEN count(r_close) OVER w20 = 20
                    THEN stddev_pop(r_close) OVER w20 END AS vol20
                  FROM returns WINDOW w20 AS ({_w} ROWS 19 PRECEDING))""",
        "train_long": f"""
            SELECT channel, value FROM (
                SELECT {', '.join(CHANNELS)} FROM raw_features
                WHERE trade_date <= DATE '{layout.split.train_end}')
            UNPIVOT (value FOR channel IN ({', '.join(CHANNELS)}))""",
        "scaler": """
            SELECT channel, lo, hi, quantile_cont(v, 0.5) AS median,
                CASE WHEN (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 > 1e-12
                    THEN (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 ELSE 1.0 END AS scale,
                count(*) AS observations
            FROM (SELECT channel, lo, hi, least(greatest(value, lo), hi) AS v
                  FROM train_long JOIN (SELECT channel, quantile_cont(value, 0.005) AS lo,
                      quantile_cont(value, 0.995) AS hi FROM train_long GROUP BY channel)
                  USING (channel))
            GROUP BY channel, lo, hi""",
        "features": f"""
            SELECT security_id, symbol, trade_date, {_scaled},
                {', '.join('observed_' + c for c in CHANNELS)} FROM raw_features""",
        "sessions": f"""
            SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session,
                lead(trade_date, {LAG}) OVER (ORDER BY trade_date) AS label_start,
                lead(trade_date, {HORIZON}) OVER (ORDER BY trade_date) AS label_end
            FROM (SELECT DISTINCT trade_date FROM universe)""",
        "normal_returns": f"""
            SELECT u.security_id, u.trade_date, u.eligible, s.label_start, s.label_end,
                a.open * a.adj_factor AS entry_value, z.close * z.adj_factor AS normal_exit
            FROM universe u JOIN sessions s USING (trade_date)
            LEFT JOIN bars a ON a.security_id = u.security_id AND a.trade_date = s.label_start
            LEFT JOIN bars z ON z.security_id = u.security_id AND z.trade_date = s.label_end""",
        "terms": """
            SELECT security_id, delist_date, coalesce(terminal_value,
                close * adj_factor * (1 + delisting_return)) AS terminal_value
            FROM delistings x LEFT JOIN bars b USING (security_id)
            WHERE b.trade_date = x.last_trade_date""",
        "exits": """
            SELECT p.*, coalesce(delist_date > trade_date AND delist_date <= label_end, false)
                AS crosses_delisting,
                CASE WHEN coalesce(delist_date > trade_date AND delist_date <= label_end, false)
                    THEN terminal_value ELSE normal_exit END AS exit_value
            FROM normal_returns p LEFT JOIN terms USING (security_id)""",
        "plain_labels": f"""
            SELECT trade_date AS asof_date, security_id, label_start, label_end, raw_return,
                benchmark_return, raw_return - benchmark_return AS target, crosses_delisting, eligible
            FROM (SELECT *, avg(CASE WHEN eligible THEN raw_return END) OVER (PARTITION BY trade_date)
                    AS benchmark_return
                  FROM (SELECT *, {ln_ratio('exit_value', 'entry_value')} AS raw_return FROM exits))""",
        "base_bounds": fold_bounds([layout.split]),
        "labels": f"""
            SELECT l.*, {split_case('b.')} AS split FROM plain_labels l, base_bounds b""",
        "bounds": fold_bounds(layout.folds),
        "fold_labels": f"""
            SELECT l.*, b.fold_id, {split_case('b.')} AS split FROM plain_labels l, bounds b""",
        "window_starts": f"""
            SELECT security_id, trade_date,
                lag(trade_date, {layout.context - 1}) OVER ({_w}) AS feature_start FROM universe""",
        "samples": """
            SELECT u.security_id || '|' || strftime(u.trade_date, '%Y-%m-%d') AS sample_id,
                u.security_id, u.symbol, u.trade_date AS asof_date, feature_start,
                u.trade_date AS feature_end, label_start, label_end, split, target, raw_return,
                benchmark_return, crosses_delisting
            FROM universe u JOIN window_starts USING (security_id, trade_date)
            JOIN labels l ON l.security_id = u.security_id AND l.asof_date = u.trade_date
            WHERE feature_start IS NOT NULL AND target IS NOT NULL AND split IS NOT NULL
                AND u.eligible""",
        "live": """
            SELECT u.security_id || '|' || strftime(u.trade_date, '%Y-%m-%d') AS sample_id,
                u.security_id, u.symbol, u.trade_date AS asof_date, feature_start,
                u.trade_date AS feature_end, u.eligible, industry_code, float_market_cap,
                CASE WHEN float_market_cap > 0 THEN ln(float_market_cap) END AS log_float_market_cap
            FROM universe u JOIN window_starts USING (security_id, trade_date)
            WHERE feature_start IS NOT NULL AND u.eligible""",
        "metadata": """
            SELECT s.sample_id, s.security_id, s.symbol, s.asof_date, s.split, u.eligible,
                u.industry_code, u.float_market_cap,
                CASE WHEN float_market_cap > 0 THEN ln(float_market_cap) END AS log_float_market_cap
            FROM samples s LEFT JOIN universe u
                ON u.security_id = s.security_id AND u.trade_date = s.asof_date""",
        "rolled": f"""
            SELECT security_id, trade_date AS asof_date, {', '.join(_rolled(c, layout.windows) for c in CHANNELS)}
            FROM features WINDOW {frames}""",
        "tabular": """
            SELECT r.*, s.sample_id, s.symbol, s.split, s.target
            FROM rolled r JOIN samples s USING (security_id, asof_date)""",
        "scored": """
            SELECT m.security_id, m.symbol, m.asof_date, m.split, t.target, m.eligible,
                m.industry_code, m.log_float_market_cap,
                round(coalesce(t.r_close__mean_20, 0.0), 9) AS score_raw
            FROM metadata m JOIN tabular t USING (sample_id)""",
        "predictions": neutral("scored"),
        "fold_train_long": f"""
            SELECT fold_id, channel, value FROM (
                SELECT fold_id, {', '.join(CHANNELS)} FROM raw_features, {fold_rows(layout.folds)}
                WHERE trade_date <= train_end)
            UNPIVOT (value FOR channel IN ({', '.join(CHANNELS)}))""",
        "fold_scalers": """
            SELECT fold_id, channel, lo, hi, quantile_cont(v, 0.5) AS median,
                CASE WHEN (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 > 1e-12
                    THEN (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 ELSE 1.0 END AS scale
            FROM (SELECT fold_id, channel, lo, hi, least(greatest(value, lo), hi) AS v
                  FROM fold_train_long JOIN (SELECT fold_id, channel, quantile_cont(value, 0.005) AS lo,
                      quantile_cont(value, 0.995) AS hi FROM fold_train_long GROUP BY fold_id, channel)
                  USING (fold_id, channel))
            GROUP BY fold_id, channel, lo, hi""",
        "fold_parameters": f"""
            SELECT fold_id, {', '.join(
                f"max(CASE WHEN channel = '{c}' THEN {v} END) AS {c}_{v}"
                for c in CHANNELS for v in ('lo', 'hi', 'median', 'scale'))}
            FROM fold_scalers GROUP BY fold_id""",
        "fold_features": f"""
            SELECT fold_id, security_id, symbol, trade_date, {', '.join(
                f"CASE WHEN {c} IS NOT NULL THEN (least(greatest({c}, {c}_lo), {c}_hi) - {c}_median) "
                f"/ {c}_scale END AS {c}" for c in CHANNELS)},
                {', '.join('observed_' + c for c in CHANNELS)} FROM raw_features, fold_parameters""",
        "fold_rolled": f"""
            SELECT fold_id, security_id, trade_date AS asof_date, {', '.join(_rolled(c, layout.windows) for c in CHANNELS)}
            FROM fold_features WINDOW {frames.replace('PARTITION BY', 'PARTITION BY fold_id,')}""",
        "fold_samples": """
            SELECT l.fold_id, u.security_id || '|' || strftime(u.trade_date, '%Y-%m-%d') AS sample_id,
                u.security_id, u.symbol, u.trade_date AS asof_date, feature_start,
                u.trade_date AS feature_end, label_start, label_end, split, target, raw_return,
                benchmark_return, crosses_delisting, u.industry_code,
                CASE WHEN float_market_cap > 0 THEN ln(float_market_cap) END AS log_float_market_cap
            FROM universe u JOIN window_starts USING (security_id, trade_date)
            JOIN fold_labels l ON l.security_id = u.security_id AND l.asof_date = u.trade_date
            WHERE feature_start IS NOT NULL AND target IS NOT NULL AND split IS NOT NULL
                AND u.eligible""",
        "fold_tabular": """
            SELECT r.*, s.sample_id, s.symbol, s.split, s.target, s.industry_code,
                s.log_float_market_cap
            FROM fold_rolled r JOIN fold_samples s USING (fold_id, security_id, asof_date)""",
        "cell_scores": f"""
            SELECT *, CASE {' '.join(_model_score(m, w) for m, w in layout.model_scores)} END AS score_raw
            FROM (SELECT t.*, model_key, seed FROM (SELECT * FROM fold_tabular WHERE split = 'valid') t,
                  (VALUES {', '.join(f"('{m}')" for m, _ in layout.model_scores)}) AS a(model_key),
                  (VALUES {', '.join(f"(CAST({s} AS BIGINT))" for s in SEEDS)}) AS b(seed))""",
        "cell_predictions": neutral(
            "(SELECT fold_id, seed, model_key, security_id, asof_date, target, score_raw, "
            "industry_code, log_float_market_cap FROM cell_scores)",
            "fold_id, seed, model_key, ",
        ),
        "cell_ic": ic("cell_predictions", "fold_id, seed, model_key, "),
        "cell_neutral_ic": ic("cell_predictions", "fold_id, seed, model_key, ", "score_neutralized"),
        "cell_book": book("cell_predictions", "fold_id, seed, model_key, ", costs=(20,)),
        "cell_daily": """
            SELECT fold_id, seed, model_key, asof_date, 'raw_rank_ic' AS metric, rank_ic AS value
            FROM cell_ic
            UNION ALL SELECT fold_id, seed, model_key, asof_date, 'neutralized_rank_ic', rank_ic
            FROM cell_neutral_ic
            UNION ALL SELECT fold_id, seed, model_key, asof_date, 'net_20bps', net_20bps
            FROM cell_book""",
    }


_NAME = re.compile(r"\b(" + "|".join(table_sql(MONTHS)) + r")\b")


def with_tables(sql: str, layout: Layout = MONTHS) -> str:
    """The statement with every stage table it reads, directly or not, put in front."""
    tables, needed = table_sql(layout), set()

    def visit(text: str, own: str | None = None) -> None:
        for name in _NAME.findall(text):
            if name != own and name not in needed:
                needed.add(name)
                visit(tables[name], name)

    visit(sql)
    sql = expand_rounding(sql)
    if not needed:
        return sql
    parts = [f"{name} AS MATERIALIZED ({tables[name]})" for name in tables if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
