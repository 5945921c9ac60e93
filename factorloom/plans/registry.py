"""Registered queries: a Spark plan over the stage tables and, where SQL can state it, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.plans.ctes import BORDER, with_tables
from factorloom.plans.stage import MONTHS, WEEKS, Layout, Stage, stage

_plans: dict[str, tuple[Callable[[Stage], DataFrame], Layout]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | Callable[[Layout], str] | None = None, *, weekly: bool = False):
    """Register a plan over the monthly stage, and as ``name_weekly`` over the weekly one.

    ``sql`` may depend on the layout.
    """

    def register(plan: Callable[[Stage], DataFrame]):
        for layout, own in ((MONTHS, name), (WEEKS, f"{name}_weekly"))[: 2 if weekly else 1]:
            _plans[own] = plan, layout
            if sql is not None:
                _sql[own] = with_tables(sql if isinstance(sql, str) else sql(layout), layout)
        return plan

    return register


def on_grid(value: Column, digits: int = 6) -> Column:
    scale = 10.0**digits
    return F.floor(value.cast("double") * scale + BORDER) / scale


def tidy(frame: DataFrame) -> DataFrame:
    """Doubles onto the comparison grid of 1e-6, whole numbers to BIGINT."""

    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = on_grid(value)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            value = value.cast("long")
        return value.alias(field.name)

    return frame.select(*[column(f) for f in frame.schema.fields])


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Callable[[Stage], DataFrame], layout: Layout):
        return lambda spark, sf_dir: tidy(plan(stage(spark, sf_dir, layout)))

    return {name: bind(*found) for name, found in _plans.items()}


def oracle_queries() -> dict[str, str]:
    return dict(_sql)
