"""Stage tables derived from the given tables, each built once per session and stored.

One supplier plays a security and one calendar month of shipments a session; in the second layout
five suppliers and one week, which gives a calendar long enough for every default window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, log_if_positive
from factorloom.functions.session import fresh_path, materialize, tune
from factorloom.operators.features import apply_robust_scaler, build_features, fit_robust_scaler
from factorloom.operators.indexes import inference_index, sample_index, sample_metadata
from factorloom.operators.labels import build_labels
from factorloom.operators.metrics import (
    Section,
    book_of,
    cross_section_stats,
    net_name,
    quantile_legs,
    ranked_sections,
    section_ic,
)
from factorloom.operators.neutralize import neutralize
from factorloom.operators.research import MODEL_KEYS, NEUTRALIZED, RAW
from factorloom.operators.scoring import momentum_score, prediction_frame
from factorloom.operators.splits import (
    FoldData,
    SplitDates,
    assign_splits,
    session_dates,
    stack_folds,
    walk_forward_datasets,
    walk_forward_splits,
)
from factorloom.operators.tabular import WINDOWS, multiscale_columns, multiscale_features
from factorloom.operators.universe import build_universe, impute_delistings
from factorloom.operators.windows import pack_series

REVISION = "tpch"
LAG, HORIZON = 1, 5
UNIVERSE_RULES = {"min_listed_sessions": 24, "min_price": 1.0, "min_adv20_usd": 1.0}
SEEDS = (17, 42, 73)
LINEAGE = {"model_id": "momentum", "checkpoint_hash": "none", "dataset_id": "base"}


@dataclass(frozen=True)
class Layout:
    """How the given tables become a panel: securities, sessions, windows and splits."""

    name: str
    period: str  # of shipments in a session
    suppliers: int  # consecutive suppliers of a security
    context: int
    windows: tuple[int, ...]
    split: SplitDates
    folds: tuple[SplitDates, ...]
    # Features behind the deterministic scores that stand in for the four models.
    model_scores: tuple[tuple[str, tuple[tuple[str, float], ...]], ...]

    @property
    def columns(self) -> list[str]:
        return multiscale_columns(CHANNELS, self.windows, self.context)


MONTHS = Layout(
    name="months",
    period="month",
    suppliers=1,
    context=24,
    windows=(5, 20),
    split=SplitDates(dt.date(1998, 12, 1), dt.date(2000, 6, 1), dt.date(2001, 9, 1), 2),
    folds=(
        SplitDates(dt.date(1998, 1, 1), dt.date(1999, 2, 1), dt.date(1999, 9, 1), 2, "fold_a"),
        SplitDates(dt.date(1999, 2, 1), dt.date(2000, 3, 1), dt.date(2000, 10, 1), 2, "fold_b"),
        SplitDates(dt.date(2000, 3, 1), dt.date(2001, 3, 1), dt.date(2001, 9, 1), 2, "fold_c"),
    ),
    model_scores=(
        ("e0", (("r_close__mean_20", 1.0),)),
        ("e1", (("vol20__last", 1.0),)),
        ("e2", (("r_gap__mean_5", 1.0), ("range__last", -0.5))),
        ("e3", (("r_close__mean_20", -1.0), ("vol20__last", 0.5))),
    ),
)

# Some 357 sessions, so that every default window fits; five suppliers trade in nearly every week.
WEEKS = Layout(
    name="weeks",
    period="week",
    suppliers=5,
    context=252,
    windows=WINDOWS,
    split=SplitDates(dt.date(2000, 12, 4), dt.date(2001, 5, 7), dt.date(2001, 10, 29), 5),
    folds=(
        SplitDates(dt.date(2000, 7, 17), dt.date(2000, 11, 6), dt.date(2001, 3, 5), 2, "fold_a"),
        SplitDates(dt.date(2000, 10, 2), dt.date(2001, 2, 12), dt.date(2001, 6, 4), 2, "fold_b"),
        SplitDates(dt.date(2000, 12, 18), dt.date(2001, 5, 7), dt.date(2001, 10, 29), 2, "fold_c"),
    ),
    model_scores=(
        ("e0", (("r_close__mean_252", 1.0),)),
        ("e1", (("vol20__mean_120", 1.0),)),
        ("e2", (("r_gap__mean_60", 1.0), ("range__last", -0.5))),
        ("e3", (("r_close__mean_120", -1.0), ("vol20__last", 0.5))),
    ),
)
CONTEXT, SPLIT, FOLDS = MONTHS.context, MONTHS.split, MONTHS.folds

_stages: dict[tuple[str, str, str], "Stage"] = {}


def stage(spark: SparkSession, sf_dir: str, layout: Layout = MONTHS) -> "Stage":
    key = (spark.sparkContext.applicationId, sf_dir, layout.name)
    if key not in _stages:
        _stages[key] = Stage(tune(spark), sf_dir, layout)
    return _stages[key]


def _security(supplier: str, suppliers: int) -> Column:
    """Consecutive suppliers share a security."""
    return F.col(supplier) if suppliers == 1 else F.expr(f"({supplier} - 1) div {suppliers}")


def derive_bars(lineitem: DataFrame, layout: Layout = MONTHS) -> DataFrame:
    """Bars per security and session; securities ending in 9 leave the market in 2000."""
    c = F.col
    price = F.try_divide("l_extendedprice", "l_quantity")
    order_columns = (
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    order = F.struct(*order_columns)
    key = c("_key")
    lineitem = lineitem.withColumn("_key", _security("l_suppkey", layout.suppliers))
    kept = lineitem.filter(~((key % 10 == 9) & (c("l_shipdate") >= F.lit(dt.datetime(2000, 1, 1)))))
    dated = kept.select(
        key, F.trunc("l_shipdate", layout.period).alias("trade_date"), *order_columns, "l_discount"
    )
    # Few lines of a bar are in one file: sorting them for a first grouping there would only spill.
    months = dated.repartition("_key", "trade_date").groupBy("_key", "trade_date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("dollar_volume"),
        (1 - F.avg("l_discount")).alias("adj_factor"),
    )
    text = key.cast("string")
    symbol = F.concat(F.lit("S"), text)
    return months.select(
        F.concat(F.lit("sec:"), text).alias("security_id"),
        symbol.alias("symbol"),
        "trade_date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "dollar_volume",
        "adj_factor",
        F.lit(REVISION).alias("source_revision"),
        F.when(key % 3 == 0, "NASDAQ").when(key % 3 == 1, "NYSE").otherwise("AMEX").alias("exchange_source"),
        F.when(key % 17 == 0, "ETF").otherwise("Common Stock").alias("security_type_source"),
        F.lit("provider_symbol_fallback").alias("identity_quality"),
        F.concat(symbol, F.lit(".US")).alias("provider_symbol"),
        (key % 10 == 9).alias("is_delisted_source"),
    )


def security_number() -> Column:
    return F.substring("security_id", 5, 20).cast("long")


def model_score(weights: Sequence[tuple[str, float]], seed: Column) -> Column:
    """Weighted features plus a small seeded offset per security, rounded to 9 digits."""
    base = F.lit(0.0)
    for feature, weight in weights:
        base = base + weight * F.coalesce(F.col(feature), F.lit(0.0))
    offset = (security_number() * seed) % 1009 / F.lit(1009.0) * 0.5
    return F.round(base + offset, 9)


class Stage:
    """Lazily built stage tables; each attribute is stored on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, layout: Layout = MONTHS):
        self.spark = spark
        self.layout = layout
        self.sf_dir = sf_dir
        self.snapshot_root = fresh_path(spark, "snapshots")
        self._stored: dict[str, DataFrame] = {}
        self._folds: list[FoldData] = []
        self._results: dict[str, dict[str, DataFrame]] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = materialize(build(), name)
        return self._stored[name]

    def result(self, name: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Several tables that one call builds, kept for all queries that read one of them."""
        if name not in self._results:
            self._results[name] = build()
        return self._results[name]

    @property
    def bars(self) -> DataFrame:
        return self._once("bars", lambda: derive_bars(self.table("lineitem"), self.layout))

    def exposures(self) -> DataFrame:
        """Region as industry and account balance as market cap, of a security's first supplier."""
        suppliers = self.layout.suppliers
        return (
            self.table("supplier")
            .filter((F.col("s_suppkey") - 1) % suppliers == 0)
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                F.concat(F.lit("sec:"), _security("s_suppkey", suppliers).cast("string")).alias("security_id"),
                F.col("r_name").alias("industry_code"),
                F.col("s_acctbal").alias("float_market_cap"),
            )
        )

    @property
    def universe(self) -> DataFrame:
        def build() -> DataFrame:
            grid = build_universe(self.bars, **UNIVERSE_RULES)
            plain = grid.drop("industry_code", "float_market_cap")
            return plain.join(self.exposures(), "security_id", "left")

        return self._once("universe", build)

    @property
    def delistings(self) -> DataFrame:
        return self._once(
            "delistings",
            lambda: impute_delistings(self.bars, self.universe, source_revision=REVISION),
        )

    @property
    def raw_features(self) -> DataFrame:
        return self._once("raw-features", lambda: build_features(self.bars, self.universe))

    @property
    def scaler(self) -> DataFrame:
        return self._once("scaler", lambda: fit_robust_scaler(self.raw_features, self.layout.split.train_end))

    @property
    def features(self) -> DataFrame:
        return self._once("features", lambda: apply_robust_scaler(self.raw_features, self.scaler))

    @property
    def plain_labels(self) -> DataFrame:
        return self._once(
            "plain-labels",
            lambda: build_labels(self.bars, self.universe, self.delistings, LAG, HORIZON),
        )

    @property
    def calendar(self) -> DataFrame:
        return session_dates(self.universe)

    @property
    def labels(self) -> DataFrame:
        return self._once(
            "labels", lambda: assign_splits(self.plain_labels, self.calendar, self.layout.split)
        )

    @property
    def fold_labels(self) -> DataFrame:
        return self._once(
            "fold-labels", lambda: walk_forward_splits(self.plain_labels, self.calendar, self.layout.folds)
        )

    @property
    def samples(self) -> DataFrame:
        return self._once(
            "samples", lambda: sample_index(self.features, self.labels, self.universe, self.layout.context)
        )

    @property
    def live(self) -> DataFrame:
        return self._once("live", lambda: inference_index(self.features, self.universe, self.layout.context))

    @property
    def packed(self) -> DataFrame:
        """The scaled features as a store of series; chunks of one context, so that a calendar as
        short as these has several."""
        context = self.layout.context
        return self._once(
            "packed", lambda: pack_series(self.features, context_length=context, chunk_length=context)
        )

    @property
    def metadata(self) -> DataFrame:
        return self._once("metadata", lambda: sample_metadata(self.samples, self.universe))

    def _tabular_rows(self) -> DataFrame:
        """The tabular features, not stored: a reader of few columns builds only those."""
        return multiscale_features(
            self.features, self.samples, windows=self.layout.windows, context_length=self.layout.context
        )

    @property
    def tabular(self) -> DataFrame:
        return self._once("tabular", self._tabular_rows)

    @property
    def predictions(self) -> DataFrame:
        def build() -> DataFrame:
            score = momentum_score("r_close__mean_20").alias("score_raw")
            scores = materialize(self._tabular_rows().select("sample_id", score), "scores")
            return prediction_frame(self.samples, self.metadata, scores, **LINEAGE)

        return self._once("predictions", build)

    def _fold_rows(self, table: str) -> DataFrame:
        """A table of all folds, not stored: a reader of few columns builds only those."""
        if not self._folds:
            self._folds = walk_forward_datasets(
                self.raw_features,
                self.plain_labels,
                self.universe,
                self.layout.folds,
                context_length=self.layout.context,
                windows=self.layout.windows,
            )
        return stack_folds(self._folds, table)

    def _fold_table(self, table: str) -> DataFrame:
        return self._once(f"fold-{table}", lambda: self._fold_rows(table))

    @property
    def fold_features(self) -> DataFrame:
        return self._fold_table("features")

    @property
    def fold_samples(self) -> DataFrame:
        return self._fold_table("samples")

    @property
    def fold_tabular(self) -> DataFrame:
        return self._fold_table("tabular")

    @property
    def cell_predictions(self) -> DataFrame:
        """Valid rows of every fold, scored by every model and seed."""

        def build() -> DataFrame:
            scores = dict(self.layout.model_scores)
            features = sorted({f for weights in scores.values() for f, _ in weights})
            valid = self._fold_rows("tabular").filter("split = 'valid'").select(
                "fold_id", "security_id", "asof_date", "target", *features
            )
            rows = materialize(valid, "fold-valid")
            exposures = self.universe.select(
                "security_id",
                F.col("trade_date").alias("asof_date"),
                "industry_code",
                log_if_positive(F.col("float_market_cap")).alias("log_float_market_cap"),
            )
            cell = F.explode(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("model_key"), F.lit(s).cast("long").alias("seed"))
                        for m in MODEL_KEYS
                        for s in SEEDS
                    ]
                )
            )
            score = F.coalesce(
                *[
                    F.when(F.col("model_key") == m, model_score(scores[m], F.col("seed")))
                    for m in MODEL_KEYS
                ]
            )
            scored = (
                rows.join(exposures, ["security_id", "asof_date"])
                .withColumn("_cell", cell)
                .select("*", "_cell.*")
                .withColumn("score_raw", score)
                .select(
                    "fold_id",
                    "seed",
                    "model_key",
                    "security_id",
                    "asof_date",
                    "target",
                    "score_raw",
                    "industry_code",
                    "log_float_market_cap",
                )
            )
            return neutralize(scored, ["fold_id", "seed", "model_key"])

        return self._once("cell-predictions", build)

    @property
    def cell_daily(self) -> DataFrame:
        """Long daily metrics of every cell: fold, seed, model, date, metric, value."""

        def build() -> DataFrame:
            cells, by = self.cell_predictions, ["fold_id", "seed", "model_key"]
            net = net_name(20.0)
            sections = [Section(RAW, "score_raw"), Section(NEUTRALIZED, "score_neutralized")]
            ranked = materialize(ranked_sections(cells, sections, by), "ranked")
            keys = [*by, "asof_date"]
            series = section_ic(ranked, by).select(
                *keys, F.col("section").alias("metric"), F.col("rank_ic").alias("value")
            )
            legs = quantile_legs(ranked.filter(F.col("section") == RAW))
            book = book_of(legs, by, costs_bps=[20.0])
            return series.unionByName(book.select(*keys, F.lit(net).alias("metric"), F.col(net).alias("value")))

        return self._once("cell-daily", build)

    @property
    def cells(self) -> DataFrame:
        """One row per cell of the matrix, with lineage and the readiness of its fold."""
        valid = self.fold_samples.filter("split = 'valid'")
        ready = cross_section_stats(valid, ["fold_id"]).select(
            "fold_id", F.col("research_ready").alias("source_research_ready")
        )
        return (
            self.cell_predictions.groupBy("fold_id", "seed", "model_key")
            .agg(F.count(F.lit(1)).alias("rows"))
            .join(F.broadcast(ready), "fold_id")
            .select(
                "fold_id",
                "seed",
                "model_key",
                F.concat(F.lit("ds-"), "fold_id").alias("dataset_id"),
                F.lit("valid").alias("evaluation_split"),
                "source_research_ready",
                "rows",
            )
        )
