"""Every registered query of the engine with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans.dialect import duckdb_sql, spark_sql
from strandloom.plans.sql import SQL
from strandloom.plans.views import with_views

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer scan tasks than cores, dealt out: one file with one row group would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the tables of a folder, each read where the query names it."""
    whole = spark_sql(with_views(text))
    args = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", whole)}
    whole = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(args) or '-'})\b(?!\s+AS\s+\()", r"\1 {\2}", whole)
    return spark.sql(whole, **args)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandloom.plans import columns, graphs, indexes, iterative

    return {name: partial(run_sql, text=text) for name, text in SQL.items()} | iterative.queries() | graphs.queries() | indexes.queries() | columns.queries()


def oracle_sql() -> dict[str, str]:
    from strandloom.plans import oracles

    return {name: duckdb_sql(with_views(text)) for name, text in SQL.items()} | oracles.oracle_sql()
