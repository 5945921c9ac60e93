"""Exact positions and ranks inside groups of any size.

A date's cross-section can be far larger than one task should sort. Rows are range-partitioned on
the whole order, so a group of any share of the data spreads over many tasks; each partition's
rows are numbered and shifted by the rows before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.session import materialize

# A group is cut into parts of about PART_ROWS rows, at most MOST_PARTS of them. Cuts are chosen
# among the rows whose hash falls in one of CUT_SAMPLE classes; ranks are exact for any choice.
PART_ROWS, MOST_PARTS, CUT_SAMPLE = 1 << 16, 1 << 8, 1 << 10

# monotonically_increasing_id keeps the partition in the upper 31 bits.
_PARTITION_SHIFT = 33


def with_position(
    frame: DataFrame,
    name: str,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    *,
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based position in ``order`` (a total order), and optionally the group size.

    The sorted rows are stored once: counts and rows then see the same partitions.
    """
    stored = stamped(frame.orderBy(*group, *order), "sorted")
    return numbered(stored, name, group, size=size, together=True).select(
        *frame.columns, name, *([size] if size else [])
    )


def stamped(ordered: DataFrame, label: str) -> DataFrame:
    """A sorted table, stored once, with the partition and place of each row."""
    return materialize(
        ordered.withColumn("__stamp", F.monotonically_increasing_id()), label
    ).withColumn("__part", F.shiftright("__stamp", _PARTITION_SHIFT))


def numbered(
    stored: DataFrame,
    name: str,
    group: Sequence[str],
    *,
    size: str | None = None,
    together: bool = False,
) -> DataFrame:
    """The 1-based position of each row of a stamped table among its group's rows.

    Any group will do, also one that the sort does not know: its rows are counted in the stored
    order, in each partition and in the partitions before. Where the sort keeps a group's rows
    ``together``, the place in the partition is enough and no row is exchanged.
    """
    place = F.col("__stamp") - F.shiftleft(F.col("__part"), _PARTITION_SHIFT)
    if not together:
        # Rows of one group in one partition: as many as a sort partition holds at most.
        place = F.row_number().over(Window.partitionBy("__part", *group).orderBy("__stamp")) - 1
    rows = stored.withColumn("__place", place)
    first = F.min("__place") if together else F.lit(0)
    counts = (rows if together else stored).groupBy("__part", *group).agg(
        F.count(F.lit(1)).alias("__rows"), first.alias("__first")
    )
    by_group = Window.partitionBy(*group)
    earlier = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns(
        {
            "__offset": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first"),
            "__members": F.sum("__rows").over(by_group),
        }
    ).drop("__rows", "__first")
    placed = join_same(rows, starts, ["__part", *group]).withColumn(name, F.col("__place") + F.col("__offset") + 1)
    if size:
        placed = placed.withColumn(size, F.col("__members"))
    return placed.drop("__place", "__offset", "__members", "__part", "__stamp")


def tie_ranked(
    stored: DataFrame, position: str, rank: str, value: str, group: Sequence[str], *, size: str
) -> DataFrame:
    """Position, group size and average rank of each row of a table sorted by ``value`` in its groups.

    Ties are consecutive in the stored order, so a partition knows them; only the first and last
    ones of a group that several partitions hold may go on in another. Those are counted apart: at
    most two rows for each group and sort partition that cuts it.
    """
    own, count = Window.partitionBy("__part", *group), F.count(F.lit(1))
    peers = own.orderBy(value)
    rows = stored.withColumns(
        {
            "__place": F.row_number().over(own.orderBy("__stamp")),
            "__before": F.rank().over(peers) - 1,
            "__ties": count.over(peers.rangeBetween(Window.currentRow, Window.currentRow)),
            "__held": count.over(own),
        }
    )
    by_group = Window.partitionBy(*group)
    earlier = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("__part", *group)
        .agg(count.alias("__rows"))
        .withColumns(
            {
                "__offset": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)),
                "__members": F.sum("__rows").over(by_group),
            }
        )
        .drop("__rows")
    )
    # Stored, so that the join knows its true size.
    placed = join_same(rows, materialize(starts, "group-starts"), ["__part", *group])
    c = F.col
    outer = (c("__before") == 0) | (c("__before") + c("__ties") == c("__held"))
    placed = placed.withColumns(
        {
            position: c("__place") + c("__offset"),
            "__low": c("__before") + c("__offset") + 1,
            "__cut": (c("__members") > c("__held")) & outer,
        }
    )
    across = placed.filter("__cut").groupBy(*group, value).agg(F.min("__low").alias("__least"), count.alias("__all"))
    whole = join_same(placed, F.broadcast(across), [*group, value], "left")
    low, ties = F.coalesce("__least", "__low"), F.coalesce("__all", "__ties")
    return whole.select(
        *[name for name in stored.columns if not name.startswith("__")],
        position,
        c("__members").alias(size),
        (low + (ties - 1) / 2).alias(rank),
    )


def cut_places(
    rows: DataFrame, group: Sequence[str], values: Sequence[str], unique: str = "security_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Number the groups and cut each, for every value, into parts in the order (value, unique).

    Returns the groups (``group``, __place, n), the rows (__place, ``unique``, the values and a
    __part_<value> for each) and what ``part_ranked`` must know of the parts. Both small tables are
    stored: one row per group, and one per group, value and part.
    """
    c = F.col
    sampled = [F.pmod(F.xxhash64(unique, v), F.lit(CUT_SAMPLE)) == 0 for v in values]
    chosen = rows.filter(F.array_contains(F.array(*sampled), True)).groupBy(*group).agg(
        *[
            F.sort_array(F.collect_list(F.when(s, F.struct(c(v).alias("value"), c(unique).alias("key"))))).alias(v)
            for v, s in zip(values, sampled)
        ]
    )

    def thinned(value: str) -> Column:
        step = F.greatest(F.lit(PART_ROWS // CUT_SAMPLE), F.ceil(F.size(value) / MOST_PARTS)).cast("int")
        return F.filter(c(value), lambda cut, at: at % step == step - 1)

    cuts = chosen.select(*group, *[thinned(v).alias(f"__cuts_{v}") for v in values])
    counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    numbered_groups = join_same(counted, cuts, group, "left").withColumn(
        "__place", F.monotonically_increasing_id()
    )
    places = materialize(numbered_groups, "places")

    def row(value: str) -> Column:
        return F.struct(c(value).alias("value"), c(unique).alias("key"))

    def held(value: str) -> Column:
        """The part, and the value where it is also the value of a cut: such ties may be in two parts."""
        found = F.coalesce(c(f"__cuts_{value}"), F.array().cast(places.schema[f"__cuts_{value}"].dataType))
        return F.struct(
            F.size(F.filter(found, lambda cut: cut < row(value))).alias("part"),
            F.exists(found, lambda cut: cut["value"].eqNullSafe(c(value))).alias("tied"),
        )

    placed = join_same(rows, places, group).select(
        "__place", unique, *values, *[held(v).alias(f"__held_{v}") for v in values]
    )
    long = placed.select(
        "__place",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("measure"),
                        c(f"__held_{v}.part").alias("part"),
                        c(f"__held_{v}.tied").alias("tied"),
                        F.when(c(f"__held_{v}.tied"), c(v).cast("double")).alias("value"),
                    )
                    for v in values
                ]
            )
        ),
    )
    # From here on one row per group, value, part and cut.
    counts = long.groupBy("__place", "measure", "part", "tied", "value").agg(F.count(F.lit(1)).alias("rows"))
    parts = materialize(counts, "part-counts")
    by_part = Window.partitionBy("__place", "measure")
    sizes = (
        parts.groupBy("__place", "measure", "part")
        .agg(F.sum("rows").alias("held"))
        .withColumn("until", F.sum("held").over(by_part.orderBy("part")))
    )
    ties = (
        parts.filter("tied")
        .join(sizes, ["__place", "measure", "part"])
        .groupBy("__place", "measure", "value")
        # In the first part that holds them, they are its last rows.
        .agg(F.sum("rows").alias("all"), F.min_by(c("until") - c("rows") + 1, c("part")).alias("low"))
        .groupBy("__place", "measure")
        .agg(F.collect_list(F.struct("value", "low", "all")).alias("__cut_ties"))
    )
    starts = sizes.join(ties, ["__place", "measure"], "left").select(
        "__place", "measure", "part", (c("until") - c("held")).alias("__offset"), "__cut_ties"
    )
    return (
        places.select(*group, "__place", "n"),
        placed.select("__place", unique, *values, *[c(f"__held_{v}.part").alias(f"__part_{v}") for v in values]),
        materialize(starts, "group-starts"),
    )


def part_ranked(
    rows: DataFrame,
    starts: DataFrame,
    value: str,
    rank: str,
    *,
    position: str | None = None,
    unique: str = "security_id",
) -> DataFrame:
    """Average rank, and optionally position, of rows of ``cut_places`` in their group by ``value``.

    One exchange by group and part. The ties of a value that is a cut are in ``starts``.
    """
    c, part = F.col, f"__part_{value}"
    own = Window.partitionBy("__place", part)
    peers = own.orderBy(value)
    if position:
        # First, so that the windows over ties find its order.
        rows = rows.withColumn("__at", F.row_number().over(own.orderBy(value, unique)))
    rows = rows.withColumns(
        {
            "__low": F.rank().over(peers),
            "__ties": F.count(F.lit(1)).over(peers.rangeBetween(Window.currentRow, Window.currentRow)),
        }
    )
    known = starts.filter(c("measure") == value).select("__place", c("part").alias(part), "__offset", "__cut_ties")
    placed = rows.join(known, ["__place", part])
    cut = F.get(F.filter("__cut_ties", lambda t: t["value"].eqNullSafe(c(value).cast("double"))), F.lit(0))
    low, ties = F.coalesce(cut["low"], c("__low") + c("__offset")), F.coalesce(cut["all"], c("__ties"))
    placed = placed.withColumn(rank, low + (ties - 1) / 2)
    if position:
        placed = placed.withColumn(position, c("__at") + c("__offset"))
    return placed.drop("__at", "__low", "__ties", "__offset", "__cut_ties", part)


def with_average_rank(
    frame: DataFrame,
    name: str,
    value: str,
    group: Sequence[str],
    *,
    unique: Sequence[str] = ("security_id",),
) -> DataFrame:
    """Add 1-based ranks of a non-NULL value; ties share their average rank."""
    placed = with_position(frame, "_position", [value, *unique], group)
    ties = placed.groupBy(*group, value).agg(
        (F.min("_position") + (F.count(F.lit(1)) - 1) / 2).alias(name)
    )
    return join_same(placed, ties, [*group, value]).select(*frame.columns, name)


def join_same(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join each row to its group; a NULL key is a group of its own, as in a window."""
    marks = {key: f"_key_{key}" for key in keys}
    renamed = groups.withColumnsRenamed(marks)
    same = [F.col(key).eqNullSafe(F.col(mark)) for key, mark in marks.items()]
    return rows.join(renamed, same, how).drop(*marks.values())
