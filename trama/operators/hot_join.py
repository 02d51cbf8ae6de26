"""Equi-joins and lookups that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds this part of the rows, so there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 256
#: Slots over which a hot key is spread.
SLOTS = 64
#: Rows from which hot keys are told.
SAMPLE = 20_000


def hot_keys(df: DataFrame, key: str, n: int | None = None, share: float = HOT_SHARE) -> list:
    """The hot keys of df, told from a sample of about SAMPLE rows: at most 2/share of them, however large df is.

    In the sample a key counts as hot from half of share on, so that one which holds share is missed about once in a
    million times. A key taken or missed by chance changes only how the work is spread, never a result. Null keys are
    never hot, as they never join.
    """
    if n is None:
        n = df.count()
    if n == 0:
        return []
    part = min(1.0, SAMPLE / n)
    rows = df.select(key).filter(F.col(key).isNotNull())
    if part < 1:
        rows = rows.sample(part, seed=7)
    return [r[0] for r in rows.groupBy(key).count().filter(F.col("count") >= max(2.0, n * part * share / (2 if part < 1 else 1))).select(key).collect()]


def slot(key: Column, hot: list, spread: Column, slots: int = SLOTS) -> Column:
    """Slot of a row on the side with many rows: by the hash of spread for a hot key, else 0."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(slots)).cast("int")).otherwise(F.lit(0))


def in_slots(df: DataFrame, key: str, hot: list, slots: int = SLOTS) -> DataFrame:
    """The side with one row a key: a hot key once in every slot, others in slot 0."""
    if not hot:
        return df.withColumn("_slot", F.lit(0))
    return df.withColumn("_slot", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(F.array(F.lit(0)))))


def hot_lookup(many: DataFrame, key: str, spread: str, one: DataFrame, hot: list, how: str = "inner") -> DataFrame:
    """many joined with one (unique in key) on key; hot keys of many are spread by the column spread."""
    if not hot:
        return many.join(one, key, how)
    left = many.withColumn("_slot", slot(F.col(key), hot, F.col(spread)))
    return left.join(in_slots(one, key, hot), [key, "_slot"], how).drop("_slot")
