"""Queries on universe construction, features, scaling, tabular features and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS
from factorloom.functions.session import materialize
from factorloom.operators import features as ft
from factorloom.operators import tabular as tb
from factorloom.operators import universe as un
from factorloom.operators import windows as wn
from factorloom.operators.indexes import inference_index
from factorloom.plans import payload_stage as p
from factorloom.plans.ctes import d, n
from factorloom.plans.registry import on_grid, query
from factorloom.plans.stage import CONTEXT, REVISION, UNIVERSE_RULES, Layout, Stage
from factorloom.sources import payloads

KEYS = ["security_id", "trade_date"]


def _grid(s: Stage) -> DataFrame:
    calendar = materialize(un.session_calendar(s.bars), "calendar")
    return un.session_grid(un.build_security_ranges(s.bars, calendar), calendar)


def _observed(s: Stage) -> DataFrame:
    return un.attach_observations(_grid(s), s.bars)


@query(
    "c1_build_security_ranges",
    """SELECT security_id, first_trade_date, last_trade_date, eventually_delisted, exchange_source,
        security_type_source, fallback_symbol, provider_symbol, range_end FROM ranges""",
)
def _(s: Stage) -> DataFrame:
    ranges = un.build_security_ranges(s.bars, un.session_calendar(s.bars))
    return ranges.drop("identity_quality")


@query("c2_session_grid", "SELECT security_id, trade_date, range_end FROM grid")
def _(s: Stage) -> DataFrame:
    return _grid(s).select(*KEYS, "range_end")


@query(
    "c3_attach_observations",
    f"SELECT security_id, trade_date, symbol, {d('close', 'dollar_volume')} FROM observed",
)
def _(s: Stage) -> DataFrame:
    return _observed(s).select(*KEYS, "symbol", "close", "dollar_volume")


@query("c4_adv20", f"SELECT security_id, trade_date, {d('adv20_usd')} FROM observed")
def _(s: Stage) -> DataFrame:
    return un.adv20(_observed(s)).select(*KEYS, "adv20_usd")


@query("c5_listed_days", f"SELECT security_id, trade_date, {n('listed_days')} FROM observed")
def _(s: Stage) -> DataFrame:
    return un.listed_days(_grid(s)).select(*KEYS, "listed_days")


@query(
    "c6_map_exchange",
    f"""SELECT name, is_delisted, CASE exchange WHEN 'NASDAQ' THEN 'XNAS' WHEN 'NYSE' THEN 'XNYS'
        WHEN 'AMEX' THEN 'XASE' ELSE 'US' END AS market
    FROM {p.SYMBOL_ROWS_SQL}""",
)
def _(s: Stage) -> DataFrame:
    return p.symbol_rows(s).select(
        F.col("Name").alias("name"),
        F.col("IsDelisted").alias("is_delisted"),
        payloads.map_exchange(F.lower("Exchange")).alias("market"),
    )


@query(
    "c7_normalize_security_type",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'common_stock'
        ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') END AS kind
    FROM part""",
)
def _(s: Stage) -> DataFrame:
    source = F.when(F.col("p_partkey") % 4 == 0, " Common--Stock! ").otherwise(F.col("p_type"))
    return s.table("part").select(
        "p_partkey", payloads.normalize_security_type(source).alias("kind")
    )


@query(
    "c8_trade_status",
    """SELECT security_id, trade_date, is_listed, is_delisted, is_halted, trade_status_quality
    FROM states""",
)
def _(s: Stage) -> DataFrame:
    return un.trade_status(_observed(s)).select(
        *KEYS, "is_listed", "is_delisted", "is_halted", "trade_status_quality"
    )


@query(
    "c9_eligible_candidate",
    "SELECT security_id, trade_date, eligible AS eligible_candidate FROM candidates",
)
def _(s: Stage) -> DataFrame:
    return un.eligible_candidate(
        s.universe.drop("eligible"), **UNIVERSE_RULES
    ).select(*KEYS, "eligible_candidate")


TOP = 5


@query(
    "c10_daily_liquidity_topk",
    f"""SELECT security_id, trade_date, CASE WHEN eligible THEN rank END AS liquidity_rank,
        eligible AND rank <= {TOP} AS eligible
    FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, eligible
            ORDER BY adv20_usd DESC NULLS LAST, security_id) AS rank FROM universe)""",
)
def _(s: Stage) -> DataFrame:
    candidates = s.universe.select(*KEYS, "adv20_usd", F.col("eligible").alias("eligible_candidate"))
    return un.daily_liquidity_topk(candidates, TOP).select(*KEYS, "liquidity_rank", "eligible")


@query(
    "c10_daily_liquidity_first",
    f"""SELECT security_id, trade_date, CASE WHEN eligible AND rank <= {TOP} THEN rank END AS liquidity_rank,
        eligible AND rank <= {TOP} AS eligible
    FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, eligible
            ORDER BY adv20_usd DESC NULLS LAST, security_id) AS rank FROM universe)""",
)
def _(s: Stage) -> DataFrame:
    """Only the first of each date ranked, by bounded lists of each task."""
    candidates = s.universe.select(*KEYS, "adv20_usd", F.col("eligible").alias("eligible_candidate"))
    first = un.daily_liquidity_topk(candidates, TOP, rank_all=False)
    return first.select(*KEYS, "liquidity_rank", "eligible")


@query(
    "c_build_universe",
    f"""SELECT security_id, symbol, trade_date, {n('listed_days')}, exchange, security_type, is_listed,
        is_delisted, is_halted, {d('close', 'adv20_usd')}, eligible, trade_status_quality,
        provider_symbol FROM candidates""",
)
def _(s: Stage) -> DataFrame:
    return un.build_universe(s.bars, **UNIVERSE_RULES).select(
        "security_id",
        "symbol",
        "trade_date",
        "listed_days",
        "exchange",
        "security_type",
        "is_listed",
        "is_delisted",
        "is_halted",
        "close",
        "adv20_usd",
        "eligible",
        "trade_status_quality",
        "provider_symbol",
    )


@query(
    "c11_impute_delistings",
    f"""SELECT security_id, delist_date, last_trade_date, {d('delisting_return')}, known_at,
        source_revision, is_imputed, imputation_method, exchange FROM delistings""",
)
def _(s: Stage) -> DataFrame:
    return un.impute_delistings(s.bars, s.universe, source_revision=REVISION).drop("terminal_value")


@query(
    "c12_discover_candidates",
    f"""SELECT 'S' || k || '.US' AS provider_symbol, name, exchange, is_delisted, in_active, in_delisted
    FROM (SELECT *, bool_or(NOT is_delisted) OVER (PARTITION BY code) AS in_active,
            bool_or(is_delisted) OVER (PARTITION BY code) AS in_delisted
          FROM {p.SYMBOL_ROWS_SQL} WHERE exchange IN ('NASDAQ', 'NYSE') AND type = 'Common Stock')
    QUALIFY row_number() OVER (PARTITION BY code ORDER BY copy DESC) = 1""",
)
def _(s: Stage) -> DataFrame:
    symbols = p.symbol_rows(s)
    found = payloads.discover_candidates(
        symbols.filter("NOT IsDelisted"),
        symbols.filter("IsDelisted"),
        exchange_code="US",
        exchanges=["nasdaq", "NYSE "],
        security_types=["common_stock"],
    )
    return found.select(
        "provider_symbol",
        F.col("Name").alias("name"),
        F.col("Exchange").alias("exchange"),
        "is_delisted",
        "in_active",
        "in_delisted",
    )


@query(
    "c12_discovery_audit",
    f"""SELECT (SELECT count(*) FROM supplier) AS active_metadata_rows,
        (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 9) AS delisted_metadata_rows,
        count(*) FILTER (NOT is_delisted) AS active_candidates,
        count(*) FILTER (is_delisted) AS delisted_candidates,
        count(DISTINCT code) AS candidate_count
    FROM {p.SYMBOL_ROWS_SQL} WHERE exchange IN ('NASDAQ', 'NYSE') AND type = 'Common Stock'""",
)
def _(s: Stage) -> DataFrame:
    symbols = p.symbol_rows(s)
    active, gone = symbols.filter("NOT IsDelisted"), symbols.filter("IsDelisted")
    found = payloads.discover_candidates(
        active,
        gone,
        exchange_code="US",
        exchanges=["NASDAQ", "NYSE"],
        security_types=["common_stock"],
    )
    return payloads.discovery_audit(active, gone, found)


@query(
    "c13_select_top_liquid",
    """SELECT 'P' || p_partkey || '.US' AS provider_symbol,
        round6(p_retailprice) AS close, round6(v) AS avgvol_200d,
        round6(p_retailprice * v) AS dollar_liquidity_200d,
        row_number() OVER (ORDER BY p_retailprice * v DESC, 'P' || p_partkey) AS liquidity_rank
    FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey)
        ON l_partkey = p_partkey
    WHERE p_partkey % 13 <> 0 AND p_partkey % 3 < 2 AND p_partkey % 5 <> 0 AND p_retailprice >= 5
        AND v >= 100
    ORDER BY liquidity_rank LIMIT 20""",
)
def _(s: Stage) -> DataFrame:
    return _top_liquid(s).select(
        "provider_symbol", "close", "avgvol_200d", "dollar_liquidity_200d", "liquidity_rank"
    )


_LIQUID = {
    "exchanges": ["NASDAQ", "NYSE"],
    "security_types": ["Common Stock"],
    "min_price": 5.0,
    "min_avg_volume": 100.0,
}


def _top_liquid(s: Stage) -> DataFrame:
    return payloads.select_top_liquid(
        p.part_symbols(s), p.bulk_rows(s), k=20, exchange_code="US", **_LIQUID
    )


@query(
    "c13_top_liquid_audit",
    """WITH bulk AS (SELECT p_partkey AS k, p_retailprice AS close, v FROM part JOIN (SELECT l_partkey,
            sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey),
        passing AS (SELECT *, close * v AS liquidity FROM bulk WHERE k % 13 <> 0 AND k % 3 < 2
            AND k % 5 <> 0 AND close >= 5 AND v >= 100),
        chosen AS (SELECT * FROM passing ORDER BY liquidity DESC, 'P' || k LIMIT 20)
    SELECT count(*) AS selected, '2001-11-01' AS date_min, '2001-11-01' AS date_max,
        round6(max(liquidity)) AS liquidity_max, round6(min(liquidity)) AS liquidity_min,
        (SELECT count(*) FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 <> 0) AS in_scope_symbols,
        (SELECT count(*) FROM bulk) AS bulk_rows, (SELECT count(*) FROM passing) AS passing_rows
    FROM chosen""",
)
def _(s: Stage) -> DataFrame:
    return payloads.top_liquid_audit(_top_liquid(s), p.part_symbols(s), p.bulk_rows(s), **_LIQUID)


# Features


def _panel(s: Stage) -> DataFrame:
    return ft.feature_panel(s.bars, s.universe)


@query(
    "d1_feature_panel",
    "SELECT security_id, symbol, trade_date, round6(ao) AS adj_open, "
    "round6(ah) AS adj_high, round6(al) AS adj_low, round6(ac) AS adj_close, "
    f"{d('volume', 'dollar_volume')} FROM panel",
)
def _(s: Stage) -> DataFrame:
    return _panel(s)


def _channel(name: str, table: str = "returns"):
    return f"SELECT security_id, trade_date, {d(name)} FROM {table}"


for _id, _name in (
    ("d2", "r_close"),
    ("d3", "r_gap"),
    ("d4", "r_intraday"),
    ("d5", "range"),
    ("d6", "dlog_volume"),
):

    @query(f"{_id}_{_name}", _channel(_name))
    def _(s: Stage, name: str = _name) -> DataFrame:
        return ft.with_returns(_panel(s)).select(*KEYS, name)


@query("d7_dollar_volume_z20", _channel("dollar_volume_z20"))
def _(s: Stage) -> DataFrame:
    return ft.with_dollar_volume_z(_panel(s)).select(*KEYS, "dollar_volume_z20")


@query(
    "d7_dollar_volume_z20_linear",
    """SELECT security_id, trade_date, round6(CASE WHEN size = 20 THEN (dollar_volume - m) * 1.349
        / nullif(q75 - q25, 0) END) AS dollar_volume_z20
    FROM (SELECT *, count(dollar_volume) OVER w AS size, quantile_cont(dollar_volume, 0.25) OVER w AS q25,
            quantile_cont(dollar_volume, 0.5) OVER w AS m,
            quantile_cont(dollar_volume, 0.75) OVER w AS q75
          FROM panel WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS 19 PRECEDING))""",
)
def _(s: Stage) -> DataFrame:
    scored = ft.with_dollar_volume_z(_panel(s), interpolation="linear")
    return scored.select(*KEYS, "dollar_volume_z20")


@query("d8_vol20", _channel("vol20", "raw_features"))
def _(s: Stage) -> DataFrame:
    return ft.with_volatility(ft.with_returns(_panel(s))).select(*KEYS, "vol20")


@query(
    "d9_observed_mask",
    f"""SELECT security_id, symbol, trade_date, {d(*CHANNELS)},
        {', '.join('observed_' + c for c in CHANNELS)} FROM raw_features""",
)
def _(s: Stage) -> DataFrame:
    return ft.build_features(s.bars, s.universe)


@query(
    "d10_fit_robust_scaler",
    """SELECT channel, round6(lo) AS winsor_lower_value, round6(hi)
        AS winsor_upper_value, round6(median) AS median, round6(scale) AS scale,
        observations AS train_observations FROM scaler""",
)
def _(s: Stage) -> DataFrame:
    return ft.fit_robust_scaler(s.raw_features, s.layout.split.train_end)


@query(
    "d11_apply_robust_scaler",
    f"SELECT security_id, trade_date, {d(*CHANNELS)} FROM features",
)
def _(s: Stage) -> DataFrame:
    return ft.apply_robust_scaler(s.raw_features, s.scaler).select(*KEYS, *CHANNELS)


@query(
    "d12_multiscale_features",
    lambda l: f"SELECT sample_id, security_id, symbol, asof_date, split, {d('target', *l.columns)} FROM tabular",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return tb.multiscale_features(
        s.features, s.samples, windows=s.layout.windows, context_length=s.layout.context
    )


# All default windows that the months can fill.
LONG = 60
LONG_WINDOWS = [w for w in tb.WINDOWS if w <= LONG]


def _long_sql() -> str:
    columns = []
    for c in CHANNELS:
        columns.append(f"round6({c}) AS {c}__last")
        for w in LONG_WINDOWS:
            over = f"OVER (PARTITION BY security_id ORDER BY trade_date ROWS {w - 1} PRECEDING)"
            for stat, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
                columns.append(
                    f"round6(CASE WHEN count({c}) {over} = {w} THEN {fn}({c}) {over} END) "
                    f"AS {c}__{stat}_{w}"
                )
    return ", ".join(columns)


@query(
    "d12_multiscale_long_windows",
    f"""SELECT r.* FROM (SELECT security_id, trade_date AS asof_date, {_long_sql()} FROM features) r
    JOIN universe u ON u.security_id = r.security_id AND u.trade_date = r.asof_date
    JOIN (SELECT security_id, trade_date, lag(trade_date, {LONG - 1}) OVER (PARTITION BY security_id
        ORDER BY trade_date) AS start FROM universe) w
        ON w.security_id = r.security_id AND w.trade_date = r.asof_date
    WHERE u.eligible AND w.start IS NOT NULL""",
)
def _(s: Stage) -> DataFrame:
    index = inference_index(s.features, s.universe, LONG)
    rows = tb.multiscale_inference_features(s.features, index, context_length=LONG)
    return rows.drop("sample_id", "symbol")


@query(
    "d13_multiscale_inference_features",
    lambda l: f"""SELECT l.sample_id, security_id, l.symbol, asof_date, {d(*l.columns)}
    FROM rolled JOIN live l USING (security_id, asof_date)""",
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return tb.multiscale_inference_features(
        s.features, s.live, windows=s.layout.windows, context_length=s.layout.context
    )


@query(
    "d14_fit_tabular_preprocessor",
    lambda l: " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round6(coalesce(avg({c}), 0)) AS mean, "
        f"round6(CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END) AS scale "
        "FROM tabular WHERE split = 'train'"
        for c in l.columns
    ),
    weekly=True,
)
def _(s: Stage) -> DataFrame:
    return tb.fit_tabular_preprocessor(s.tabular.filter("split = 'train'"), s.layout.columns)


def _standard_sql(l: Layout) -> str:
    shown = ", ".join(
        f"round4(CAST(CAST(CASE WHEN {c} IS NOT NULL THEN ({c} - {c}_mean) / {c}_scale ELSE 0 END AS FLOAT) "
        f"AS DOUBLE)) AS z{i}, CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS m{i}"
        for i, c in enumerate(l.columns)
    )
    fitted = ", ".join(
        f"coalesce(avg({c}), 0) AS {c}_mean, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END "
        f"AS {c}_scale"
        for c in l.columns
    )
    return f"SELECT sample_id, {shown} FROM tabular, (SELECT {fitted} FROM tabular WHERE split = 'train')"


@query("d15_transform_tabular", _standard_sql, weekly=True)
def _(s: Stage) -> DataFrame:
    columns = s.layout.columns
    fitted = tb.fit_tabular_preprocessor(s.tabular.filter("split = 'train'"), columns)
    vectors = tb.transform_tabular(s.tabular, fitted, columns)
    width = len(columns)
    return vectors.select(
        "sample_id",
        *[on_grid(F.col("vector")[i], 4).alias(f"z{i}") for i in range(width)],
        *[F.col("vector")[width + i].alias(f"m{i}") for i in range(width)],
    )


# Windows and patches. Values are single precision, so four digits are compared.

LENGTH, STRIDE = 6, 3
PATCHES = wn.patch_count(CONTEXT, LENGTH, STRIDE)


def _windows(s: Stage) -> DataFrame:
    return wn.cut_windows(s.packed, s.samples, context_length=s.layout.context)


def _steps(channels, index: str) -> str:
    """One row per sample and window step."""
    values = ", ".join(
        f"CASE WHEN f.{c} IS NOT NULL THEN f.{c} ELSE 0 END AS {c}, f.{c} IS NOT NULL AS observed_{c}"
        for c in channels
    )
    return f"""(SELECT s.sample_id,
            row_number() OVER (PARTITION BY s.sample_id ORDER BY f.trade_date) - 1 AS step, {values}
        FROM {index} s JOIN features f ON f.security_id = s.security_id
            AND f.trade_date BETWEEN s.feature_start AND s.asof_date)"""


def _window_sql(index: str) -> str:
    shown = ", ".join(f"round4(CAST(CAST({c} AS FLOAT) AS DOUBLE)) AS {c}, observed_{c}" for c in CHANNELS)
    return f"SELECT sample_id, step, {shown} FROM {_steps(CHANNELS, index)}"


def _window_rows(windows: DataFrame) -> DataFrame:
    rows = windows.select(
        "sample_id", F.posexplode(F.arrays_zip("values", "observed_mask")).alias("step", "w")
    )
    return rows.select(
        "sample_id",
        F.col("step").cast("long").alias("step"),
        *[
            on_grid(F.col("w.values")[i], 4).alias(c)
            for i, c in enumerate(CHANNELS)
        ],
        *[F.col("w.observed_mask")[i].alias(f"observed_{c}") for i, c in enumerate(CHANNELS)],
    )


@query("d16_context_windows", _window_sql("samples"))
def _(s: Stage) -> DataFrame:
    return _window_rows(_windows(s))


@query("d16_inference_windows", _window_sql("live"))
def _(s: Stage) -> DataFrame:
    return _window_rows(wn.context_windows(s.features, s.live, context_length=s.layout.context))


def _packed_sql(l: Layout) -> str:
    size, overlap = l.context, l.context - 1
    sums = ", ".join(
        f"round4(sum(CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE))) AS {c}, count({c}) AS observed_{c}"
        for c in CHANNELS
    )
    return f"""SELECT security_id, chunk, count(*) FILTER (i < chunk * {size}) AS home, count(*) AS steps,
        min(trade_date) AS first_date, max(trade_date) AS last_date, {sums}
    FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS i FROM features) f
    JOIN range(100) c(chunk) ON i >= chunk * {size} - {overlap} AND i < (chunk + 1) * {size}
    GROUP BY security_id, chunk HAVING max(i) >= chunk * {size}"""


@query("d16_packed_series", _packed_sql, weekly=True)
def _(s: Stage) -> DataFrame:
    """The store of series: bounds and sums of each chunk."""

    def total(i: int):
        return F.aggregate("values", F.lit(0.0), lambda a, v: a + v[i].cast("double"))

    def seen(i: int):
        return F.size(F.filter("observed_mask", lambda m: m[i]))

    return s.packed.select(
        "security_id",
        "chunk",
        "home",
        F.size("dates").alias("steps"),
        F.array_min("dates").alias("first_date"),
        F.array_max("dates").alias("last_date"),
        *[on_grid(total(i), 4).alias(c) for i, c in enumerate(CHANNELS)],
        *[seen(i).cast("long").alias(f"observed_{c}") for i, c in enumerate(CHANNELS)],
    )


def _window_sums_sql(l: Layout) -> str:
    """Sums over each sample's window, and its first and last step."""
    frame = f"OVER (PARTITION BY security_id ORDER BY trade_date ROWS {l.context - 1} PRECEDING)"
    values = ", ".join(
        f"sum(CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE)) {frame} AS {c}, count({c}) {frame} AS observed_{c}, "
        f"CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE) AS last_{c}"
        for c in CHANNELS
    )
    shown = ", ".join(f"round4({c}) AS {c}, observed_{c}, round4(last_{c}) AS last_{c}" for c in CHANNELS)
    return f"""SELECT sample_id, CAST({l.context} AS BIGINT) AS steps, {shown}
    FROM samples s JOIN (SELECT security_id, trade_date, {values} FROM features) f
        ON f.security_id = s.security_id AND f.trade_date = s.asof_date"""


@query("d16_window_sums", _window_sums_sql, weekly=True)
def _(s: Stage) -> DataFrame:
    """Windows of the sample index out of the store, summed up."""
    last = F.element_at("values", -1)

    def total(i: int):
        return F.aggregate("values", F.lit(0.0), lambda a, v: a + v[i].cast("double"))

    def seen(i: int):
        return F.size(F.filter("observed_mask", lambda m: m[i]))

    return _windows(s).select(
        "sample_id",
        F.size("values").cast("long").alias("steps"),
        *[on_grid(total(i), 4).alias(c) for i, c in enumerate(CHANNELS)],
        *[seen(i).cast("long").alias(f"observed_{c}") for i, c in enumerate(CHANNELS)],
        *[on_grid(last[i], 4).alias(f"last_{c}") for i, c in enumerate(CHANNELS)],
    )


def _patches(s: Stage) -> DataFrame:
    return wn.patchify(_windows(s), context_length=CONTEXT, length=LENGTH, stride=STRIDE)


_long_steps = " UNION ALL ".join(
    f"SELECT sample_id, step, '{c}' AS channel, CAST({c} AS FLOAT) AS v, observed_{c} AS o FROM steps"
    for c in CHANNELS
)
_patch_steps = f"""steps AS MATERIALIZED (SELECT * FROM {_steps(CHANNELS, 'samples')}),
    long AS MATERIALIZED ({_long_steps}),
    patched AS MATERIALIZED (SELECT sample_id, channel, patch_index, v, o
        FROM long, range({PATCHES}) r(patch_index)
        WHERE step BETWEEN patch_index * {STRIDE} AND patch_index * {STRIDE} + {LENGTH - 1})"""


@query(
    "d17_patchify",
    f"""SELECT sample_id, channel, patch_index, bool_or(o) AS patch_observed,
        count(*) FILTER (o) AS observed, round4(sum(CAST(v AS DOUBLE))) AS total,
        any_value(channel_observed) AS channel_observed
    FROM (WITH {_patch_steps} SELECT * FROM patched
          JOIN (SELECT sample_id, channel, bool_or(o) AS channel_observed FROM long GROUP BY ALL)
          USING (sample_id, channel))
    GROUP BY sample_id, channel, patch_index""",
)
def _(s: Stage) -> DataFrame:
    rows = wn.explode_patches(_patches(s))
    total = F.aggregate("patch_values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select(
        "sample_id",
        "channel",
        F.col("patch_index").cast("long").alias("patch_index"),
        "patch_observed",
        F.size(F.filter("patch_mask", lambda o: o)).cast("long").alias("observed"),
        on_grid(total, 4).alias("total"),
        "channel_observed",
    )


@query(
    "d18_masked_patch_sample",
    f"""SELECT sample_id, channel, patch_index, row_number() OVER (PARTITION BY sample_id, channel
            ORDER BY md5('17:0|' || sample_id || '|' || channel || '|' || patch_index), patch_index)
            <= {PATCHES} - floor({PATCHES} * 0.6) AS masked
    FROM samples, (VALUES {', '.join(f"('{c}')" for c in CHANNELS)}) c(channel), range({PATCHES}) r(patch_index)""",
)
def _(s: Stage) -> DataFrame:
    masked = wn.masked_patch_sample(_patches(s), ratio=0.4, seed=17)
    return masked.select("sample_id", "channel", "patch_index", "masked")


@query(
    "d18_masked_patch_counts",
    f"""SELECT sample_id, channel, CAST({PATCHES} AS BIGINT) AS patches,
        CAST({PATCHES} - floor({PATCHES} * 0.6) AS BIGINT) AS masked
    FROM samples, (VALUES {', '.join(f"('{c}')" for c in CHANNELS)}) c(channel)""",
)
def _(s: Stage) -> DataFrame:
    drawn = wn.masked_patch_sample(_patches(s), ratio=0.4, seed=17)
    return drawn.groupBy("sample_id", "channel").agg(
        F.count(F.lit(1)).alias("patches"), F.count_if("masked").alias("masked")
    )


@query(
    "d18_masked_reconstruction_loss",
    f"""SELECT loss_name, round4(avg(CASE WHEN loss_name = 'mse' THEN g * g
            WHEN abs(g) <= 1 THEN 0.5 * g * g ELSE abs(g) - 0.5 END)) AS loss,
        count(*) AS valid_elements
    FROM (WITH {_patch_steps} SELECT 0.25 - CAST(v AS DOUBLE) AS g FROM patched
          WHERE o AND patch_index % 3 = 0), (VALUES ('mse'), ('huber')) l(loss_name)
    GROUP BY loss_name""",
)
def _(s: Stage) -> DataFrame:
    constant = F.transform("patch_values", lambda x: F.lit(0.25))
    rows = wn.explode_patches(_patches(s)).withColumns(
        {"masked": F.col("patch_index") % 3 == 0, "prediction": constant}
    )
    return wn.masked_reconstruction_loss(rows).withColumn("loss", on_grid(F.col("loss"), 4))
