"""Landed provider payloads (JSON) mapped to the standard tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.operators.quality import checked

# One JSON object per provider symbol, holding the symbol's list of daily rows.
EOD_SCHEMA = """
    provider_symbol string,
    rows array<struct<date: string, open: double, high: double, low: double, close: double,
                      adjusted_close: double, volume: double>>
"""
DIVIDEND_SCHEMA = """
    provider_symbol string,
    rows array<struct<date: string, declarationDate: string, value: double, currency: string>>
"""
SPLIT_SCHEMA = "provider_symbol string, rows array<struct<date: string, split: string>>"
SYMBOL_SCHEMA = """
    Code string, Name string, Exchange string, Currency string, Type string, Isin string,
    IsDelisted boolean
"""

# Exchange names as providers spell them, and their market codes.
EXCHANGE_CODES = {
    "NASDAQ": "XNAS",
    "NYSE": "XNYS",
    "NYSE ARCA": "ARCX",
    "NYSE MKT": "XASE",
    "AMEX": "XASE",
    "OTCQX": "OTCM",
    "OTCQB": "OTCM",
    "PINK": "OTCM",
    "US": "US",
}

# Security type aliases after normalisation.
COMMON_STOCK_ALIASES = ("common_stock", "common", "stock")

# Fixed value: how adj_factor was derived.
ADJUSTMENT_BASIS = "adjusted_close_over_raw_close_splits_and_dividends"


def lookup(key: Column, table: dict[str, str | float], default: Column) -> Column:
    entries = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    return F.coalesce(F.try_element_at(entries, key), default)


def present(value: Column) -> Column:
    """NULL for an empty string, as a missing payload field."""
    return F.when(value != "", value)


def map_exchange(source: Column) -> Column:
    named = F.coalesce(source, F.lit("US"))
    return lookup(F.upper(named), EXCHANGE_CODES, named)


def normalize_security_type(source: Column) -> Column:
    text = F.lower(F.btrim(F.coalesce(present(source), F.lit("unknown"))))
    slug = F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug.isin(*COMMON_STOCK_ALIASES), "common_stock").otherwise(
        F.coalesce(present(slug), F.lit("unknown"))
    )


def provider_symbol(code: Column, exchange_code: str) -> Column:
    name = F.upper(F.btrim(code))
    return F.when(F.contains(name, F.lit(".")), name).otherwise(
        F.concat(name, F.lit(f".{exchange_code.upper()}"))
    )


def display_symbol(symbol: Column) -> Column:
    return F.upper(F.regexp_replace(symbol, r"\.[^.]*$", ""))


def security_id(symbol: Column, isin: Column, provider: str) -> Column:
    clean = present(F.btrim(isin))
    return F.coalesce(
        F.concat(F.lit(f"{provider}:isin:"), F.upper(clean)),
        F.concat(F.lit(f"{provider}:symbol:"), F.upper(symbol)),
    )


def identity_quality(isin: Column) -> Column:
    return F.when(F.btrim(isin) != "", "isin").otherwise("provider_symbol_fallback")


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def payload_rows(payload: DataFrame) -> DataFrame:
    return payload.select("provider_symbol", F.explode("rows").alias("r")).select(
        "provider_symbol", "r.*"
    )


def build_metadata_index(
    symbols: DataFrame, exchange_code: str, precedence: Column | str = "precedence"
) -> DataFrame:
    """One metadata row per provider symbol: the row of highest precedence wins.

    Rows of equal precedence are told apart by their contents, so the winner never depends on
    the order in which tasks see them.
    """
    named = symbols.filter(F.col("Code") != "").withColumn(
        "provider_symbol", provider_symbol(F.col("Code"), exchange_code)
    )
    ordering = F.col(precedence) if isinstance(precedence, str) else precedence
    row = F.struct(
        F.col("Isin").alias("isin"),
        F.col("Name").alias("name"),
        F.coalesce(present(F.col("Exchange")), F.lit(exchange_code)).alias("exchange"),
        F.coalesce(present(F.col("Currency")), F.lit("USD")).alias("currency"),
        F.coalesce(present(F.col("Type")), F.lit("Common Stock")).alias("security_type"),
        F.coalesce(F.col("IsDelisted"), F.lit(False)).alias("is_delisted"),
    )
    # max_by combines on the map side, so copies of one symbol never meet in one task.
    return (
        named.groupBy("provider_symbol")
        .agg(F.max_by(row, F.struct(ordering, row)).alias("m"))
        .select("provider_symbol", "m.*")
    )


def identify(metadata: DataFrame, provider: str) -> DataFrame:
    symbol, isin = F.col("provider_symbol"), F.col("isin")
    return metadata.withColumns(
        {
            "security_id": security_id(symbol, isin, provider),
            "identity_quality": identity_quality(isin),
        }
    )


def _with_identity(rows: DataFrame, metadata: DataFrame, provider: str) -> DataFrame:
    known = metadata.select("provider_symbol", "isin", "exchange", "security_type", "is_delisted")
    return identify(rows.join(known, "provider_symbol", "left"), provider)


def map_eod_bars(
    rows: DataFrame,
    metadata: DataFrame,
    *,
    provider: str,
    source_revision: str,
    ingested_at: str,
    check: bool = True,
) -> DataFrame:
    """Daily payload rows to bars; the adjustment factor is adjusted over raw close.

    The bars are stored and must keep their contract, unless told otherwise.
    """
    adjusted = F.coalesce(F.col("adjusted_close"), F.col("close"))
    bars = _with_identity(rows, metadata, provider).select(
        "security_id",
        display_symbol(F.col("provider_symbol")).alias("symbol"),
        F.try_to_date("date", "yyyy-MM-dd").alias("trade_date"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        (F.col("close") * F.col("volume")).alias("dollar_volume"),
        F.try_divide(adjusted, F.col("close")).alias("adj_factor"),
        F.lit(source_revision).alias("source_revision"),
        F.to_timestamp(F.lit(ingested_at)).alias("ingested_at"),
        F.lit(provider).alias("provider"),
        "provider_symbol",
        adjusted.alias("adjusted_close"),
        F.lit(ADJUSTMENT_BASIS).alias("adjustment_basis"),
        "identity_quality",
        F.col("exchange").alias("exchange_source"),
        F.col("security_type").alias("security_type_source"),
        F.coalesce("is_delisted", F.lit(False)).alias("is_delisted_source"),
    )
    return checked(bars, "bars") if check else bars


def map_dividends(
    rows: DataFrame, metadata: DataFrame, *, provider: str, source_revision: str
) -> DataFrame:
    ex_date = F.try_to_date("date", "yyyy-MM-dd")
    declared = F.try_to_date("declarationDate", "yyyy-MM-dd")
    timely = F.coalesce(declared <= ex_date, F.lit(False))
    return _with_identity(rows, metadata, provider).select(
        "security_id",
        ex_date.alias("ex_date"),
        F.lit("cash_dividend").alias("action_type"),
        F.lit(1.0).alias("price_factor"),
        F.lit(1.0).alias("volume_factor"),
        F.col("value").alias("cash_amount"),
        F.when(timely, declared).otherwise(ex_date).alias("known_at"),
        F.lit(source_revision).alias("source_revision"),
        "provider_symbol",
        "currency",
        F.when(timely, "declaration_date").otherwise("ex_date_assumed").alias("known_at_quality"),
    )


def map_splits(
    rows: DataFrame, metadata: DataFrame, *, provider: str, source_revision: str
) -> DataFrame:
    """Split ratios ``new/old``; a malformed or non-positive ratio stops the job."""
    parts = F.split("split", "/")
    new, old = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    valid = (F.size(parts) == 2) & (new > 0) & (old > 0)
    bad = F.raise_error(F.concat(F.lit("invalid split ratio: "), F.col("split"))).cast("double")
    ex_date = F.try_to_date("date", "yyyy-MM-dd")
    return _with_identity(rows, metadata, provider).select(
        "security_id",
        ex_date.alias("ex_date"),
        F.lit("split").alias("action_type"),
        F.when(valid, old / new).otherwise(bad).alias("price_factor"),
        F.when(valid, new / old).otherwise(bad).alias("volume_factor"),
        F.lit(0.0).alias("cash_amount"),
        ex_date.alias("known_at"),
        F.lit(source_revision).alias("source_revision"),
        "provider_symbol",
        F.lit(None).cast("string").alias("currency"),
        F.lit("ex_date_assumed").alias("known_at_quality"),
    )


def map_corporate_actions(
    dividends: DataFrame,
    splits: DataFrame,
    metadata: DataFrame,
    *,
    provider: str,
    source_revision: str,
    check: bool = True,
) -> DataFrame:
    """Both kinds of actions, stored and checked unless told otherwise."""
    keep = {"provider": provider, "source_revision": source_revision}
    actions = map_dividends(dividends, metadata, **keep).unionByName(
        map_splits(splits, metadata, **keep)
    )
    return checked(actions, "corporate_actions") if check else actions


def union_batches(parts: list[DataFrame], table: str | None = None) -> DataFrame:
    """Stack batches mapped separately; a column missing in one is NULL there.

    With the name of a standard table, the whole must keep that contract: batches that are
    sound alone may still repeat each other's keys.
    """
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return checked(whole, table) if table else whole


def discover_candidates(
    active: DataFrame,
    delisted: DataFrame,
    *,
    exchange_code: str,
    exchanges: list[str],
    security_types: list[str],
    position: str | None = None,
) -> DataFrame:
    """In-scope symbols of both lists, one row each; the delisted row overrides.

    ``position`` names the place of a row in its list: of several rows in the overriding list the
    last one wins. Rows without a place, or at the same one, are told apart by their contents.
    """
    place = F.col(position) if position else F.lit(None).cast("long")
    listed = active.withColumn("_is_delisted", F.lit(False)).unionByName(
        delisted.withColumn("_is_delisted", F.lit(True))
    )
    scoped = _in_scope(listed, exchanges, security_types)
    row = F.struct(
        "Code", "Name", "Exchange", "Type", "Isin", F.col("_is_delisted").alias("is_delisted")
    )
    return (
        scoped.withColumn("provider_symbol", provider_symbol(F.col("Code"), exchange_code))
        .groupBy("provider_symbol")
        .agg(
            F.max_by(row, F.struct("_is_delisted", place.alias("place"), row)).alias("m"),
            F.bool_or(~F.col("_is_delisted")).alias("in_active"),
            F.bool_or("_is_delisted").alias("in_delisted"),
        )
        .select("provider_symbol", "m.*", "in_active", "in_delisted")
    )


def discovery_audit(active: DataFrame, delisted: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = {
        "active_metadata_rows": active.select(F.lit("active_metadata_rows").alias("k")),
        "delisted_metadata_rows": delisted.select(F.lit("delisted_metadata_rows").alias("k")),
        "active_candidates": candidates.filter("in_active").select(
            F.lit("active_candidates").alias("k")
        ),
        "delisted_candidates": candidates.filter("in_delisted").select(
            F.lit("delisted_candidates").alias("k")
        ),
        "candidate_count": candidates.select(F.lit("candidate_count").alias("k")),
    }
    tagged = reduce(DataFrame.unionAll, counts.values())
    return tagged.agg(*[F.count_if(F.col("k") == name).alias(name) for name in counts])


def select_top_liquid(
    metadata: DataFrame,
    bulk: DataFrame,
    *,
    k: int,
    exchange_code: str,
    exchanges: list[str],
    security_types: list[str],
    min_price: float,
    min_avg_volume: float,
    check: bool = True,
) -> DataFrame:
    """The k most liquid in-scope symbols by close x average volume, ties by code."""
    rows = _liquid_rows(metadata, bulk, exchanges, security_types, min_price, min_avg_volume)
    # k rows; stored, so that the check does not rank the market twice.
    top = materialize(rows.orderBy(F.desc("dollar_liquidity_200d"), "code").limit(k), "top")
    if check and top.count() < k:
        raise ValueError(f"fewer than {k} symbols pass the liquidity floors")
    # At most k rows remain.
    ranked = F.row_number().over(Window.orderBy(F.desc("dollar_liquidity_200d"), "code"))
    return top.withColumns(
        {
            "provider_symbol": provider_symbol(F.col("code"), exchange_code),
            "liquidity_rank": ranked.cast("long"),
        }
    )


def _liquid_rows(
    metadata: DataFrame,
    bulk: DataFrame,
    exchanges: list[str],
    security_types: list[str],
    min_price: float,
    min_avg_volume: float,
) -> DataFrame:
    """Bulk rows of in-scope symbols above both floors, with their dollar liquidity."""
    scoped = (
        _in_scope(metadata, exchanges, security_types)
        .select(F.upper(F.btrim("Code")).alias("code"))
        .distinct()
    )
    close = F.col("close").try_cast("double")
    volume = F.col("avgvol_200d").try_cast("double")
    return (
        bulk.select(
            F.upper(F.btrim("code")).alias("code"),
            close.alias("close"),
            volume.alias("avgvol_200d"),
            F.col("date").alias("asof_date"),
        )
        .filter((F.col("close") >= min_price) & (F.col("close") < float("inf")))
        .filter((F.col("avgvol_200d") >= min_avg_volume) & (F.col("avgvol_200d") < float("inf")))
        .join(scoped, "code", "left_semi")
        .withColumn("dollar_liquidity_200d", F.col("close") * F.col("avgvol_200d"))
    )


def top_liquid_audit(
    top: DataFrame,
    metadata: DataFrame,
    bulk: DataFrame,
    *,
    exchanges: list[str],
    security_types: list[str],
    min_price: float,
    min_avg_volume: float,
) -> DataFrame:
    """One row: how many symbols each step keeps, and dates and liquidity of the selection."""
    scoped = _in_scope(metadata, exchanges, security_types)
    passing = _liquid_rows(metadata, bulk, exchanges, security_types, min_price, min_avg_volume)
    count = F.count(F.lit(1))
    return top.agg(
        count.alias("selected"),
        F.min("asof_date").alias("date_min"),
        F.max("asof_date").alias("date_max"),
        F.max("dollar_liquidity_200d").alias("liquidity_max"),
        F.min("dollar_liquidity_200d").alias("liquidity_min"),
    ).withColumns(
        {
            "in_scope_symbols": scoped.agg(F.count_distinct(F.upper(F.btrim("Code")))).scalar(),
            "bulk_rows": bulk.agg(count).scalar(),
            "passing_rows": passing.agg(count).scalar(),
        }
    )


def _in_scope(symbols: DataFrame, exchanges: list[str], security_types: list[str]) -> DataFrame:
    markets = sorted({name.strip().upper() for name in exchanges})
    # Type names from the caller are normalised on the driver by the same rule as the column.
    wanted = F.array(*[normalize_security_type(F.lit(name)) for name in security_types])
    return symbols.filter(
        (F.btrim("Code") != "")
        & F.upper(F.btrim("Exchange")).isin(markets)
        & F.array_contains(wanted, normalize_security_type(F.col("Type")))
    )
