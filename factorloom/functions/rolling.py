"""Rolling mean, deviation, minimum and maximum in O(log window) steps per row.

A framed aggregate revisits every row of the frame. Here blocks of 1, 2, 4, ... rows are
built from two lagged halves, and a window is merged from the blocks of its binary digits.
Sums add up pairwise and deviations merge by the parallel variance formula, so nothing
cancels. A missing row makes every block over it NULL, which is the full-window rule.
All steps share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

STATISTICS = ("mean", "std", "min", "max")


def rolling_name(value: str, statistic: str, window: int) -> str:
    return f"{value}__{statistic}_{window}"


def _block(part: str, value: str) -> str:
    return f"`_{part}_{value}`"


def _merged(part: str, value: str, window: int) -> str:
    return f"`_{part}_{value}_{window}`"


def _joint_deviation(left: tuple, right: tuple) -> str:
    """Squared deviations of two adjacent blocks, each given as (rows, sum, deviations)."""
    (n, total, own), (m, other_total, other) = left, right
    gap = f"({total} / {n} - {other_total} / {m})"
    return f"{own} + {other} + {gap} * {gap} * {n * m / (n + m)!r}D"


def with_rolling(
    frame: DataFrame,
    values: Sequence[str],
    windows: Sequence[int],
    order: str = "trade_date",
) -> DataFrame:
    """Add one column per value, window and statistic; NULL unless the window is full.

    The many small expressions are given as SQL text, which keeps plan building short.
    """
    plain = [f"`{c}`" for c in frame.columns]

    def back(name: str, rows: int) -> str:
        over = f"OVER (PARTITION BY security_id ORDER BY {order})"
        return f"lag({name}, {rows}) {over}" if rows else name

    def doubled(value: str, size: int) -> dict[str, str]:
        """Blocks of twice the size, from the block here and the one before it."""
        total, deviation = _block("sum", value), _block("dev", value)
        low, high = _block("min", value), _block("max", value)
        return {
            total: f"{total} + {back(total, size)}",
            deviation: _joint_deviation(
                (size, total, deviation), (size, back(total, size), back(deviation, size))
            ),
            low: f"least({low}, {back(low, size)})",
            high: f"greatest({high}, {back(high, size)})",
        }

    def extended(value: str, window: int, size: int) -> dict[str, str]:
        """The window's sums with this block put before what its lower digits cover."""
        covered = window % size
        total = back(_block("sum", value), covered)
        deviation = back(_block("dev", value), covered)
        names = [_merged(part, value, window) for part in ("sum", "dev")]
        if not covered:
            return dict(zip(names, (total, deviation)))
        joint = _joint_deviation((covered, *names), (size, total, deviation))
        return dict(zip(names, (f"{names[0]} + {total}", joint)))

    def extremes(value: str, window: int, size: int) -> dict[str, str]:
        """Two overlapping blocks of the largest size cover the window."""
        return {
            _merged(part, value, window): (
                f"{pick}({_block(part, value)}, {back(_block(part, value), window - size)})"
            )
            for part, pick in (("min", "least"), ("max", "greatest"))
        }

    def select(current: DataFrame, columns: dict[str, str]) -> DataFrame:
        return current.selectExpr(*plain, *[f"{text} AS {name}" for name, text in columns.items()])

    blocks: dict[str, str] = {}
    for v in values:
        blocks.update({_block(part, v): f"`{v}`" for part in ("sum", "min", "max")})
        blocks[_block("dev", v)] = f"CASE WHEN `{v}` IS NOT NULL THEN 0.0D END"
    current = select(frame, blocks)
    finished: dict[str, str] = {}
    size, longest = 1, max(windows)
    while size <= longest:
        ready: dict[str, str] = {}
        for v in values:
            for w in windows:
                if w & size:
                    ready.update(extended(v, w, size))
                if size <= w < 2 * size:
                    ready.update(extremes(v, w, size))
        blocks = {}
        if 2 * size <= longest:
            for v in values:
                blocks.update(doubled(v, size))
        finished = {**{name: name for name in finished}, **ready}
        current = select(current, {**blocks, **finished})
        size *= 2

    def statistic(name: str, v: str, w: int) -> str:
        total = _merged("sum", v, w)
        result = {
            "mean": f"{total} / {w}",
            "std": f"sqrt(greatest({_merged('dev', v, w)}, 0.0D) / {w})",
            "min": _merged("min", v, w),
            "max": _merged("max", v, w),
        }[name]
        return f"CASE WHEN {total} IS NOT NULL THEN {result} END"

    return select(
        current,
        {
            f"`{rolling_name(v, s, w)}`": statistic(s, v, w)
            for v in values
            for w in windows
            for s in STATISTICS
        },
    )
