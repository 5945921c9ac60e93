"""Provider payloads derived from the given tables, as they would land from a provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.session import fresh_path
from factorloom.plans.stage import Stage
from factorloom.sources.payloads import EOD_SCHEMA, build_metadata_index, payload_rows, read_payload

PROVIDER = "tpch"
EXCHANGES = ["NASDAQ", "NYSE", "AMEX"]
INGESTED = "2002-01-01 00:00:00"


def symbol_rows(stage: Stage) -> DataFrame:
    """Two symbol lists stacked: the later, delisted rows take precedence."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    market = F.when(k % 3 == 0, "NASDAQ").when(k % 3 == 1, "NYSE").otherwise("AMEX")
    active = stage.table("supplier").select(
        F.concat(F.lit(" s"), text, F.lit(" ")).alias("Code"),
        F.col("s_name").alias("Name"),
        F.when(k % 11 != 0, market).alias("Exchange"),
        F.when(k % 7 != 0, "USD").alias("Currency"),
        F.when(k % 13 == 0, "Preferred-Stock")
        .when(k % 17 == 0, "ETF")
        .when(k % 19 != 0, "Common Stock")
        .alias("Type"),
        F.when(k % 4 == 0, F.concat(F.lit(" us"), F.lpad(text, 6, "0")))
        .when(k % 4 == 1, "  ")
        .alias("Isin"),
        F.lit(False).alias("IsDelisted"),
        F.lit(1).alias("precedence"),
        k.alias("k"),
    )
    gone = active.filter(k % 10 == 9).withColumns(
        {
            "Name": F.concat("Name", F.lit(" (gone)")),
            "IsDelisted": F.lit(True),
            "precedence": F.lit(2),
        }
    )
    return active.unionByName(gone)


SYMBOL_ROWS_SQL = """
    (SELECT ' s' || s_suppkey || ' ' AS code, s_name || CASE WHEN copy = 2 THEN ' (gone)' ELSE '' END
        AS name,
        CASE WHEN s_suppkey % 11 <> 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE'
            ELSE 'AMEX' END END AS exchange,
        CASE WHEN s_suppkey % 7 <> 0 THEN 'USD' END AS currency,
        CASE WHEN s_suppkey % 13 = 0 THEN 'Preferred-Stock' WHEN s_suppkey % 17 = 0 THEN 'ETF'
            WHEN s_suppkey % 19 <> 0 THEN 'Common Stock' END AS type,
        CASE s_suppkey % 4 WHEN 0 THEN ' us' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')
            WHEN 1 THEN '  ' END AS isin,
        copy = 2 AS is_delisted, copy, s_suppkey AS k
    FROM supplier, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR s_suppkey % 10 = 9)"""

METADATA_SQL = f"""
    (SELECT 'S' || k || '.US' AS provider_symbol, isin, name, coalesce(exchange, 'US') AS exchange,
        coalesce(currency, 'USD') AS currency, coalesce(type, 'Common Stock') AS security_type,
        is_delisted,
        CASE WHEN trim(isin) <> '' THEN 'tpch:isin:' || upper(trim(isin))
            ELSE 'tpch:symbol:S' || k || '.US' END AS security_id,
        CASE WHEN trim(isin) <> '' THEN 'isin' ELSE 'provider_symbol_fallback' END
            AS identity_quality
    FROM {SYMBOL_ROWS_SQL}
    QUALIFY row_number() OVER (PARTITION BY code ORDER BY copy DESC) = 1)"""


def metadata(stage: Stage) -> DataFrame:
    return build_metadata_index(symbol_rows(stage), "US")


def landed_eod(stage: Stage) -> DataFrame:
    """Daily rows per symbol written as JSON and read back; every fifth lacks adjusted_close."""
    bars = stage.bars.withColumn("k", F.substring("security_id", 5, 20).cast("long"))
    row = F.struct(
        F.date_format("trade_date", "yyyy-MM-dd").alias("date"),
        "open",
        "high",
        "low",
        "close",
        F.when(F.col("k") % 5 != 0, F.col("close") * F.col("adj_factor")).alias("adjusted_close"),
        "volume",
    )
    # One object per symbol, as providers deliver; at most one row per session in each.
    payload = bars.groupBy("provider_symbol").agg(F.collect_list(row).alias("rows"))
    path = fresh_path(stage.spark, "eod-json")
    payload.write.json(path)
    return payload_rows(read_payload(stage.spark, path, EOD_SCHEMA))


def dividend_rows(stage: Stage) -> DataFrame:
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")

    def text(date):
        return F.date_format(date, "yyyy-MM-dd")

    return stage.table("orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string"), F.lit(".US")).alias(
            "provider_symbol"
        ),
        text(day).alias("date"),
        F.when(key % 4 == 1, text(F.date_sub(day, 10)))
        .when(key % 4 == 2, text(F.date_add(day, 3)))
        .when(key % 4 == 3, text(day))
        .alias("declarationDate"),
        (F.col("o_totalprice") / 1000).alias("value"),
        F.lit("USD").alias("currency"),
        key.alias("o_orderkey"),
    )


def split_rows(stage: Stage) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return stage.table("part").select(
        F.concat(F.lit("P"), key.cast("string"), F.lit(".US")).alias("provider_symbol"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), size), "yyyy-MM-dd").alias("date"),
        F.concat((size % 4 + 1).cast("string"), F.lit("/"), (key % 3 + 1).cast("string")).alias(
            "split"
        ),
    )


def bulk_rows(stage: Stage) -> DataFrame:
    """Latest price and average volume per part; every thirteenth price is unreadable."""
    volume = stage.table("lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("avgvol_200d")
    )
    key = F.col("p_partkey")
    return (
        stage.table("part")
        .join(volume, key == F.col("l_partkey"))
        .select(
            F.concat(F.lit("p"), key.cast("string")).alias("code"),
            F.lit("2001-11-01").alias("date"),
            F.when(key % 13 == 0, "n/a")
            .otherwise(F.col("p_retailprice").cast("string"))
            .alias("close"),
            F.col("avgvol_200d").cast("string").alias("avgvol_200d"),
        )
    )


def part_symbols(stage: Stage) -> DataFrame:
    key = F.col("p_partkey")
    return stage.table("part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("Code"),
        F.when(key % 3 == 0, "nasdaq ").when(key % 3 == 1, "NYSE").otherwise("LSE").alias("Exchange"),
        F.when(key % 5 == 0, "ETF").otherwise("Common Stock").alias("Type"),
    )
