"""Exact quantiles of unbounded groups by repeated histograms.

The built-in exact percentile keeps every distinct value of a group in one task. Here each wanted
order statistic has a bracket of values, at first the whole group. One pass cuts every bracket
into ``BINS`` bins of equal width, counted map-side, and the bin that holds the statistic is the
next bracket, with the least and greatest value found in it. Brackets of at most ``KEPT`` rows,
or of one value, are read off; only those few rows are ever ordered. All brackets narrow in the
same passes: a group of n rows needs about log n / log BINS of them, and one more for each
factor of BINS between the outliers of a bracket and the rest of it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
KEPT = 1 << 16

_INF = float("inf")


@dataclass(frozen=True)
class _Bracket:
    """Rows of one group with values from low to high, and the ranks looked for among them."""

    key: tuple
    below: int  # rows of the group under the bracket
    rows: int
    low: object
    high: object
    base: float  # least and greatest finite value
    top: float
    ranks: tuple[int, ...]

    @property
    def constant(self) -> bool:
        both = (self.low, self.high)
        return self.low == self.high or all(isinstance(v, float) and math.isnan(v) for v in both)


def order_statistics(
    frame: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    *,
    bins: int = BINS,
    kept: int = KEPT,
) -> DataFrame:
    """The two order statistics around each quantile, one row per (group, probability).

    Columns: the group, probability, n, low, high, fraction; the linear quantile is
    ``low + fraction * (high - low)``. The groups must be few, as channels are. NaN is greater
    than any number.
    """
    if not group:
        raise ValueError("name at least one group column")
    rows = frame.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_value"))
    number = F.col("_value").cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < _INF), number)
    totals = (
        rows.groupBy(*group)
        .agg(
            F.count("_value").alias("n"),
            F.min("_value").alias("low"),
            F.max("_value").alias("high"),
            F.min(finite).alias("base"),
            F.max(finite).alias("top"),
        )
        .collect()
    )
    wanted, open_brackets = [], []
    for total in totals:
        key, n = tuple(total[g] for g in group), total["n"]
        places = [((n - 1) * p, float(p)) for p in probabilities]
        wanted += [(key, p, n, int(t), min(int(t) + 1, n - 1), t - int(t)) for t, p in places]
        ranks = sorted({r for k, *_, low, high, _ in wanted if k == key for r in (low, high)})
        open_brackets.append(
            _Bracket(key, 0, n, total["low"], total["high"], total["base"], total["top"], tuple(ranks))
        )
    found: dict[tuple, object] = {}
    small: list[_Bracket] = []
    while open_brackets:
        wide = []
        for b in open_brackets:
            if b.constant:
                found.update({(b.key, r): b.low for r in b.ranks})
            elif b.rows <= kept:
                small.append(b)
            else:
                wide.append(b)
        open_brackets = _narrowed(rows, group, wide, bins) if wide else []
        stuck = set(open_brackets) & set(wide)  # closer together than halves of doubles can tell
        small += stuck
        open_brackets = [b for b in open_brackets if b not in stuck]
    if small:
        found.update(_read_off(rows, group, small))
    kinds = [f"{g} {frame.schema[g].dataType.simpleString()}" for g in group]
    kind = frame.schema[value].dataType.simpleString()
    return frame.sparkSession.createDataFrame(
        [(*key, p, n, found[key, low], found[key, high], rest) for key, p, n, low, high, rest in wanted],
        ", ".join([*kinds, f"probability double, n long, low {kind}, high {kind}, fraction double"]),
    )


def _inside(rows: DataFrame, group: Sequence[str], brackets: Sequence[_Bracket]) -> DataFrame:
    """Each row once for every bracket it lies in, with the bracket's number as ``_id``."""
    kinds = [f"{g} {rows.schema[g].dataType.simpleString()}" for g in group]
    kind = rows.schema["_value"].dataType.simpleString()
    # Bounded: the groups and the statistics looked for in them are few.
    table = rows.sparkSession.createDataFrame(
        [(*b.key, i, b.low, b.high, *_origin(b)) for i, b in enumerate(brackets)],
        ", ".join([*kinds, f"_id int, _low {kind}, _high {kind}, _base double, _width double"]),
    )
    nested = table.groupBy(*group).agg(
        F.collect_list(F.struct("_id", "_low", "_high", "_base", "_width")).alias("_brackets")
    )
    met = rows.join(F.broadcast(nested), list(group))
    holds = F.filter(
        "_brackets", lambda b: (F.col("_value") >= b["_low"]) & (F.col("_value") <= b["_high"])
    )
    return met.select("_value", F.explode(holds).alias("_b")).select("_value", "_b.*")


def _origin(b: _Bracket) -> tuple[float, float]:
    """Half of the least value and of the range: halves, so that no difference overflows."""
    if b.base is None:
        return 0.0, 0.0
    return b.base * 0.5, b.top * 0.5 - b.base * 0.5


def _bin(bins: int) -> Column:
    """Ascends with the value; infinities and NaN have bins of their own."""
    number = F.col("_value").cast("double")
    share = F.coalesce(F.try_divide(number * 0.5 - F.col("_base"), F.col("_width")), F.lit(0.0))
    return (
        F.when(F.isnan(number), bins + 1)
        .when(number == _INF, bins)
        .when(number == -_INF, -1)
        .otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    )


def _narrowed(
    rows: DataFrame, group: Sequence[str], brackets: Sequence[_Bracket], bins: int
) -> list[_Bracket]:
    """The bins that hold the ranks, as brackets; one pass over the rows."""
    tallies = (
        _inside(rows, group, brackets)
        .groupBy("_id", _bin(bins).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"))
    )
    targets = rows.sparkSession.createDataFrame(
        [(i, r, r - b.below) for i, b in enumerate(brackets) for r in b.ranks], "_id int, rank long, _inner long"
    )
    # At most bins + 3 rows of a bracket.
    running = Window.partitionBy("_id").orderBy("_bin")
    hit = (F.col("_upto") - F.col("n") <= F.col("_inner")) & (F.col("_inner") < F.col("_upto"))
    chosen = (
        tallies.withColumn("_upto", F.sum("n").over(running)).join(F.broadcast(targets), "_id").filter(hit).collect()
    )
    ranks = defaultdict(list)
    for row in chosen:
        before = brackets[row["_id"]]
        same = before.key, before.below + row["_upto"] - row["n"], row["n"], row["low"], row["high"]
        ranks[same].append(row["rank"])

    def finite(v) -> bool:
        return math.isfinite(float(v))

    return [
        _Bracket(*same, *((float(same[3]), float(same[4])) if finite(same[3]) and finite(same[4]) else (None, None)),
                 tuple(sorted(found)))
        for same, found in ranks.items()
    ]


def _read_off(rows: DataFrame, group: Sequence[str], brackets: Sequence[_Bracket]) -> dict[tuple, object]:
    """The values at the ranks, from brackets of few rows."""
    tallies = _inside(rows, group, brackets).groupBy("_id", "_value").agg(F.count(F.lit(1)).alias("n"))
    targets = rows.sparkSession.createDataFrame(
        [(i, r, r - b.below) for i, b in enumerate(brackets) for r in b.ranks], "_id int, rank long, _inner long"
    )
    running = Window.partitionBy("_id").orderBy("_value")
    hit = (F.col("_upto") - F.col("n") <= F.col("_inner")) & (F.col("_inner") < F.col("_upto"))
    chosen = (
        tallies.withColumn("_upto", F.sum("n").over(running)).join(F.broadcast(targets), "_id").filter(hit).collect()
    )
    return {(brackets[row["_id"]].key, row["rank"]): row["_value"] for row in chosen}
