"""All registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.plans import alignments, calibrations, companies, features, fundamentals, models, panels, performance, technical

PLANS = (technical, calibrations, panels, performance, fundamentals, models, companies, alignments, features)


def queries():
    return {name: fn for plan in PLANS for name, fn in plan.Q.items()}


def oracle_sql():
    return {name: technical.plain_rounding(sql) for plan in PLANS for name, sql in plan.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.bollinger_signal(spark, sf_dir)
