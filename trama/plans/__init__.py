"""Query plans over the tables, by topic. Each module has QUERIES and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def modules() -> list:
    from trama.plans import evaluate, expand, general, identifiers, network, registry

    return [general, identifiers, registry, network, expand, evaluate]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trama.plans import expand

    return expand.x_edges(spark, sf_dir)
