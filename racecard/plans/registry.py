"""Registered queries: each a function of (session, folder of tables), with its SQL if SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racecard.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register the function under its own name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, so that results compare across engines."""

    def shown(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DoubleType):
            return F.round(field.name, places).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def r6(*names: str) -> str:
    """SQL select list that rounds the named columns like ``rounded``."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for a query that has to write, below the application's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
