"""Per-key figures when a few keys hold most of the rows.

Two-stage salted aggregation: every row's key is extended by a salt drawn from
the hash of its entity, partial figures are made for each (key, salt), and the
partials are merged by the key alone. Because the salt is a function of the
entity, the sets of distinct entities of two salts never overlap, so distinct
counts merge by adding and stay exact. Both stages combine on the map side, so
a key with a third of all rows sends at most one row for each entity and map
task, over ``salts`` reducers instead of one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts for each key; a key with few rows makes no more partials than it has entities.
SALTS = 64


def long_form(df: DataFrame, fields: dict[str, str], entity: str) -> DataFrame:
    """(campo, valor, entity) for every row and field: one row in, one row a field out.

    fields maps the name to report to the column. Nulls stay, as they count to
    the rows of the table. Extra columns are left behind, so their names can't clash.
    """
    pairs = [F.struct(F.lit(name).alias("campo"), F.col(f"`{c}`").cast("string").alias("valor")) for name, c in fields.items()]
    return df.select(F.explode(F.array(*pairs)).alias("_p"), F.col(f"`{entity}`").cast("string").alias("_entity")).select("_p.campo", "_p.valor", "_entity")


def salted_aggregate(long: DataFrame, salts: int = SALTS) -> DataFrame:
    """(campo, valor, linhas, empresas): rows and distinct entities of each value.

    Null and empty values are groups like any other here; a null entity counts
    as a row but not as an entity. An empty input gives no rows.
    """
    salt = F.pmod(F.xxhash64("_entity"), F.lit(salts)).cast("int")
    by_entity = long.groupBy("campo", "valor", salt.alias("_salt"), "_entity").agg(F.count(F.lit(1)).alias("_n"))
    by_salt = by_entity.groupBy("campo", "valor", "_salt").agg(F.sum("_n").alias("_n"), F.count("_entity").alias("_d"))
    return by_salt.groupBy("campo", "valor").agg(F.sum("_n").alias("linhas"), F.sum("_d").alias("empresas"))


def with_share(figures: DataFrame, long: DataFrame) -> DataFrame:
    """Adds parte, a value's part of all rows of its table (nulls and empties counted in the whole)."""
    total = long.groupBy("campo").agg(F.count(F.lit(1)).alias("_total"))  # one row a field
    return figures.join(F.broadcast(total), "campo").withColumn("parte", F.col("linhas") / F.col("_total"))


def present() -> Column:
    return F.col("valor").isNotNull() & (F.col("valor") != "")


def heavy_values(tables: list[DataFrame], share: float = 0.01, salts: int = SALTS) -> DataFrame:
    """The values that at least ``share`` of all rows of their table hold, with their figures.

    tables are frames of long_form. At most 1/share values a field can come out.
    Null and empty values are never named. Ties at the threshold are named.
    """
    long = reduce(DataFrame.unionByName, tables)
    shared = with_share(salted_aggregate(long, salts), long)
    return shared.filter(present() & (F.col("linhas") >= F.lit(share) * F.col("_total"))).drop("_total")
