"""Cross-sectional factor metrics: IC, rank IC, quantile spread, turnover, cost, stability.

Every function takes ``by``: extra group columns under which all state restarts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import correlation, rank_correlation
from factorloom.functions.ranking import cut_places, part_ranked, with_position
from factorloom.functions.session import materialize
from factorloom.operators.quality import require_comparable

# Cost scenarios in basis points, quantiles, sessions per year.
COSTS_BPS = (0.0, 10.0, 20.0, 50.0)
QUANTILES = 5
ANNUALIZATION = 252
READY_DATES = 20
READY_CROSS_SECTION = 20
SIZE_BUCKETS = ("small", "mid", "large")

SPREAD = "gross_q_high_minus_low"


def net_name(cost: float) -> str:
    return f"net_{cost:g}bps"


@dataclass(frozen=True)
class Section:
    """A score judged inside each date, or inside each ``part`` (a column) of each date."""

    name: str
    score: str
    part: str | None = None


def ranked_sections(
    predictions: DataFrame, sections: Sequence[Section], by: Sequence[str] = ()
) -> DataFrame:
    """Position and average ranks of every row in every section it belongs to.

    Columns: ``by``, asof_date, section, part (empty without parts), security_id, score, target,
    position, n, score_rank, target_rank. Rows without a score or a part are in no such section.

    Rows carry the number of their place (a section, part and date) in its stead. They are
    ranked by score and then, with the rank they have, by target; a large place is cut into
    parts for both (``cut_places``). Rows of one place and security give one row, the highest.
    """
    place = [*by, "asof_date", "section", "part"]
    members = predictions.select(
        *by,
        "asof_date",
        "security_id",
        F.col("target").cast("double").alias("target"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(section.name).alias("section"),
                        (F.lit("") if section.part is None else F.col(section.part).cast("string")).alias("part"),
                        F.col(section.score).cast("double").alias("score"),
                    )
                    for section in sections
                ]
            )
        ),
    ).filter("score IS NOT NULL AND part IS NOT NULL")
    places, rows, starts = cut_places(members, place, ["score", "target"])
    ranked = part_ranked(rows, starts, "score", "score_rank", position="position")
    ranked = part_ranked(ranked, starts, "target", "target_rank")
    found = ranked.groupBy("__place", "security_id").agg(
        *[F.max(c).alias(c) for c in ("score", "target", "position", "score_rank", "target_rank")]
    )
    return found.join(places, "__place").select(
        *place, "security_id", "score", "target", "position", "n", "score_rank", "target_rank"
    )


def section_ic(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per section, part and date: n, Pearson IC and rank IC."""
    return ranked.groupBy(*by, "section", "part", "asof_date").agg(
        F.count(F.lit(1)).alias("n"),
        correlation(F.col("score"), F.col("target")).alias("ic"),
        rank_correlation(F.col("score_rank"), F.col("target_rank")).alias("rank_ic"),
    )


def daily_ic(
    predictions: DataFrame,
    score: str = "score_raw",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per date: n, Pearson IC and rank IC of score and target."""
    ranked = ranked_sections(predictions, [Section("all", score)], by)
    return section_ic(ranked, by).drop("section", "part")


def _series_columns(value: str, annualization: int) -> dict[str, Column]:
    n, mean = F.count(value), F.avg(value)
    deviation = F.when(n > 1, F.stddev_samp(value)).when(n == 1, 0.0)
    return {
        "dates": n,
        "mean": mean,
        "std": deviation,
        "ir": F.when(deviation > 0, mean / deviation * F.sqrt(F.lit(float(annualization)))),
        "positive_ratio": F.avg((F.col(value) > 0).cast("double")),
    }


def aggregate_series(
    daily: DataFrame, value: str, by: Sequence[str] = (), annualization: int = ANNUALIZATION
) -> DataFrame:
    """Dates, mean, deviation (0 for one date), annualised ratio and positive share."""
    columns = _series_columns(value, annualization)
    return daily.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def aggregate_ic(
    daily: DataFrame, by: Sequence[str] = (), annualization: int = ANNUALIZATION
) -> DataFrame:
    """One row per group and series (ic, rank_ic); one pass over the daily table."""
    long = daily.unpivot(list(by), ["ic", "rank_ic"], "series", "value")
    return aggregate_series(long, "value", [*by, "series"], annualization)


def portfolio_legs(
    predictions: DataFrame,
    score: str = "score_raw",
    by: Sequence[str] = (),
    quantiles: int = QUANTILES,
) -> DataFrame:
    """Members of the bottom and top quantile of each date with their weights."""
    date = [*by, "asof_date"]
    usable = predictions.filter(F.col(score).isNotNull()).select(
        *date, "security_id", F.col(score).alias("_score"), "target"
    )
    placed = with_position(
        usable,
        "_position",
        ["_score", "security_id"],
        date,
        size="n",
    )
    return quantile_legs(placed.withColumnRenamed("_position", "position"), quantiles).select(
        *date, "security_id", "target", "n", "groups", "is_top", "is_bottom", "weight"
    )


def quantile_legs(placed: DataFrame, quantiles: int = QUANTILES) -> DataFrame:
    """The rows of the bottom and top quantile by ``position`` of ``n``, with their weights."""
    groups = F.least(F.lit(quantiles), F.col("n"))
    leg = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("groups")))
    top, bottom = F.col("position") > F.col("n") - F.col("leg"), F.col("position") <= F.col("leg")
    share = 1 / F.col("leg").cast("double")
    return (
        placed.filter("n >= 2")
        .withColumn("groups", groups.cast("long"))
        .withColumn("leg", leg.cast("long"))
        .withColumns({"is_top": top, "is_bottom": bottom})
        .filter("is_top OR is_bottom")
        .withColumn("weight", F.when(F.col("is_top"), share).otherwise(-share))
    )


def daily_portfolio(
    predictions: DataFrame,
    score: str = "score_raw",
    by: Sequence[str] = (),
    quantiles: int = QUANTILES,
    costs_bps: Sequence[float] = COSTS_BPS,
) -> DataFrame:
    """Per date: quantile spread, turnover against the previous usable date, net of costs.

    Each weight is emitted at its own date and, negated, at the group's next usable date:
    summing per security then gives the weight changes without a self join.
    """
    return book_of(portfolio_legs(predictions, score, by, quantiles), by, costs_bps)


def book_of(
    legs: DataFrame, by: Sequence[str] = (), costs_bps: Sequence[float] = COSTS_BPS
) -> DataFrame:
    """The daily portfolio of quantile legs."""
    date = [*by, "asof_date"]
    usable = legs.select(*date).distinct()
    # One row per group and date.
    order = Window.partitionBy(*by).orderBy("asof_date")
    following = usable.select(*date, F.lead("asof_date").over(order).alias("_next"))
    linked = legs.join(following if by else F.broadcast(following), date)
    emitted = F.explode(
        F.array(
            F.struct(F.col("asof_date").alias("date"), F.col("weight"), F.lit(True).alias("own")),
            F.struct(
                F.col("_next").alias("date"), (-F.col("weight")).alias("weight"), F.lit(False).alias("own")
            ),
        )
    )
    c = F.col
    flows = linked.withColumn("e", emitted).filter("e.date IS NOT NULL")
    per_security = flows.groupBy(*by, c("e.date").alias("asof_date"), "security_id").agg(
        F.sum("e.weight").alias("_change"),
        F.bool_or(~c("e.own")).alias("_held"),
        F.max(F.when(c("e.own"), c("n"))).alias("_n"),
        F.max(F.when(c("e.own"), c("groups"))).alias("_groups"),
        F.max(F.when(c("e.own") & c("is_top"), c("target"))).alias("_top"),
        F.max(F.when(c("e.own") & c("is_bottom"), c("target"))).alias("_bottom"),
    )
    daily = per_security.groupBy(*date).agg(
        F.max("_n").alias("n"),
        F.max("_groups").alias("groups"),
        (F.avg("_top") - F.avg("_bottom")).alias(SPREAD),
        F.when(F.bool_or("_held"), 0.5 * F.sum(F.abs("_change"))).alias("turnover"),
    )
    return net_of_cost(daily, costs_bps)


def net_of_cost(daily: DataFrame, costs_bps: Sequence[float] = COSTS_BPS) -> DataFrame:
    return daily.withColumns(
        {
            net_name(bps): F.col(SPREAD)
            - F.coalesce(F.col("turnover"), F.lit(0.0)) * F.lit(float(bps)) / 10_000
            for bps in costs_bps
        }
    )


def aggregate_portfolio(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    values = [c for c in daily.columns if c == SPREAD or c.startswith("net_")]
    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg("turnover").alias("mean_turnover"),
        *[F.avg(c).alias(c) for c in values],
    )


def cross_section_stats(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sizes = predictions.groupBy(*by, "asof_date").agg(F.count(F.lit(1)).alias("n"))
    # Over one row per date.
    stats = sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"),
        F.min("n").alias("minimum"),
        F.percentile("n", 0.5).alias("median"),
        F.avg("n").alias("mean"),
        F.max("n").alias("maximum"),
    )
    ready = (F.col("dates") >= READY_DATES) & (F.col("median") >= READY_CROSS_SECTION)
    return stats.withColumn("research_ready", ready)


def _summary(daily: DataFrame, book: DataFrame, by: Sequence[str]) -> DataFrame:
    """IC and rank IC statistics next to the portfolio averages."""
    stats = daily.groupBy(*by).agg(
        *[
            column.alias(f"{series}_{name.removesuffix('_ratio')}")
            for series in ("ic", "rank_ic")
            for name, column in _series_columns(series, ANNUALIZATION).items()
        ]
    )
    means = aggregate_portfolio(book, by).withColumnRenamed("dates", "portfolio_dates")
    return stats.join(means, list(by), "left")


def score_summary(
    predictions: DataFrame,
    by: Sequence[str],
    score: str = "score_raw",
    costs_bps: Sequence[float] = COSTS_BPS,
) -> DataFrame:
    """One row per group: IC and rank IC statistics next to the portfolio averages."""
    ranked = materialize(ranked_sections(predictions, [Section("all", score)], by), "ranked")
    book = book_of(quantile_legs(ranked), by, costs_bps)
    return _summary(section_ic(ranked, by), book, by)


def stability_by_year(predictions: DataFrame, **options) -> DataFrame:
    return score_summary(predictions.withColumn("year", F.year("asof_date")), ["year"], **options)


def stability_by_industry(predictions: DataFrame, **options) -> DataFrame:
    return score_summary(predictions.filter("industry_code IS NOT NULL"), ["industry_code"], **options)


def size_buckets(predictions: DataFrame) -> DataFrame:
    """Terciles of each date's cross-section by log-cap, ties by security."""
    sized = with_position(
        predictions.filter("log_float_market_cap IS NOT NULL"),
        "_position",
        ["log_float_market_cap", "security_id"],
        ["asof_date"],
        size="_size",
    )
    third = F.least(F.floor((F.col("_position") - 1) * 3 / F.col("_size")), F.lit(2)).cast("int")
    names = F.array(*[F.lit(name) for name in SIZE_BUCKETS])
    return sized.withColumn("size_bucket", F.get(names, third)).drop("_position", "_size")


def stability_by_size(predictions: DataFrame, **options) -> DataFrame:
    bucketed = size_buckets(predictions)
    return score_summary(bucketed, ["size_bucket"], **options)


def _restarted(book: DataFrame, costs_bps: Sequence[float]) -> DataFrame:
    """A daily book whose years start anew: no turnover on a year's first date."""
    first = F.row_number().over(Window.partitionBy("year").orderBy("asof_date")) == 1
    kept = book.select("year", "asof_date", "n", "groups", SPREAD, "turnover")
    return net_of_cost(kept.withColumn("turnover", F.when(~first, F.col("turnover"))), costs_bps)


def evaluate_predictions(
    predictions: DataFrame, costs_bps: Sequence[float] = COSTS_BPS
) -> dict[str, DataFrame]:
    """All metric tables of one stored prediction table, from one ranking of all its scores.

    The neutralized score has no rows where none is available.
    """
    unsized = predictions.filter("log_float_market_cap IS NULL")
    sized = size_buckets(predictions).unionByName(unsized.withColumn("size_bucket", F.lit(None).cast("string")))
    sections = [
        Section("raw", "score_raw"),
        Section("neutralized", "score_neutralized"),
        Section("industry_code", "score_raw", "industry_code"),
        Section("size_bucket", "score_raw", "size_bucket"),
    ]
    ranked = materialize(ranked_sections(sized, sections), "ranked")
    by = ["section", "part"]
    # One row per section, part and date each; stored, since several tables are read off them.
    daily = materialize(section_ic(ranked), "daily-ic")
    book = materialize(book_of(quantile_legs(ranked), by, costs_bps), "daily-portfolio")

    def whole(frame: DataFrame) -> DataFrame:
        scores = frame.filter(F.col("section").isin("raw", "neutralized"))
        return scores.drop("part").withColumnRenamed("section", "score")

    def parts(name: str) -> DataFrame:
        own = [f.filter(F.col("section") == name).withColumnRenamed("part", name) for f in (daily, book)]
        return _summary(*own, [name])

    def years() -> DataFrame:
        own = [
            f.filter("section = 'raw'").withColumn("year", F.year("asof_date")).drop(*by) for f in (daily, book)
        ]
        return _summary(own[0], _restarted(own[1], costs_bps), ["year"])

    return {
        "daily_ic": whole(daily),
        "daily_portfolio": whole(book),
        "ic": aggregate_ic(whole(daily), ["score"]),
        "portfolio": aggregate_portfolio(whole(book), ["score"]),
        "cross_section": cross_section_stats(predictions),
        "by_year": years(),
        "by_industry": parts("industry_code"),
        "by_size": parts("size_bucket"),
    }


def compare_runs(
    runs: DataFrame, expected_rows: DataFrame
) -> DataFrame:
    """One summary row per run of a stack of prediction tables.

    ``expected_rows`` gives the split's row count per dataset (dataset_id, expected_rows). Runs
    of different datasets, splits, samples or targets are not compared.
    """
    run = ["run_id"]
    require_comparable(runs)
    sections = [Section("raw", "score_raw"), Section("neutralized", "score_neutralized")]
    ranked = materialize(ranked_sections(runs, sections, run), "ranked")
    daily = materialize(section_ic(ranked, run), "daily-ic")
    book = book_of(quantile_legs(ranked.filter("section = 'raw'")), run)
    raw = _summary(daily.filter("section = 'raw'"), book, run)
    neutral = aggregate_series(daily.filter("section = 'neutralized'"), "rank_ic", run).select(
        "run_id", F.col("mean").alias("neutralized_mean_rank_ic")
    )
    ready = cross_section_stats(runs, run).select("run_id", "research_ready")
    sizes = (
        runs.groupBy("run_id")
        .agg(
            F.max("model_id").alias("model_id"),
            F.max("dataset_id").alias("dataset_id"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .join(expected_rows, "dataset_id", "left")
        .select(
            "run_id",
            "model_id",
            F.try_divide(F.col("_rows").cast("double"), F.col("expected_rows")).alias("coverage"),
        )
    )
    return (
        sizes.join(raw, "run_id")
        .join(neutral, "run_id", "left")
        .join(ready, "run_id")
        .select(
            "run_id",
            "model_id",
            "coverage",
            F.col("ic_mean").alias("mean_ic"),
            F.col("rank_ic_mean").alias("mean_rank_ic"),
            F.col("rank_ic_ir").alias("rank_icir"),
            SPREAD,
            "mean_turnover",
            "neutralized_mean_rank_ic",
            "research_ready",
        )
    )
