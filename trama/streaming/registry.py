"""The registry as a stream: files as they arrive, latest versions, distinct events, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def distinct_within(stream: DataFrame, keys: list[str], time: str, ttl: str) -> DataFrame:
    """The first event of each key within a time to live; later ones and late ones are dropped."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """(inicio, fim, keys, n): events of each window and key, late ones counted up to late."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), *keys, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, inicio, fim, n): runs of events of a key with pauses below gap; batch frames work as well."""
    s = stream.withWatermark(time, late) if late else stream
    g = s.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), "n")


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Keeps at path the last row of each key: every batch is merged into a new version of the table."""
    from trama.operators.tables import keep_last

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        # a batch run again after a failure writes the same version again
        old = f"{path}/v{n - 1}"
        both = batch if n == 0 else batch.unionByName(spark.read.parquet(old))
        keep_last(both, keys, [order]).write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
