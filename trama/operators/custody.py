"""The custody log: chained records, their verification, manifests of files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq bigint, ts string, case_id string, actor string, action string, target string, collector string, summary string, artifact_sha256 string, artifact_bytes bigint, metadata string, anchor string, prev string, hash string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")][:-1]


def record_hash(record: dict) -> str:
    """SHA-256 of the record's fields but its hash, as compact JSON in order of name."""
    body = {k: record.get(k) for k in sorted(FIELDS)}
    return hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def append(log: list[dict], **fields) -> dict:
    """The next record: numbered, bound to the last one's hash. The chain is sequential, so it grows on the driver."""
    last = log[-1] if log else None
    record = {k: None for k in FIELDS} | fields | {"seq": (last["seq"] + 1) if last else 1, "prev": last["hash"] if last else ""}
    record["hash"] = record_hash(record)
    log.append(record)
    return record


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def canonical_json(log: DataFrame) -> DataFrame:
    names = sorted(FIELDS)
    return log.withColumn("_json", F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"}))


def verify(log: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(case_id, seq, falha): a row for each record out of number, out of chain or changed, and each artifact missing."""
    w = Window.partitionBy("case_id").orderBy("seq")
    j = canonical_json(log).withColumns({"_want": F.row_number().over(w), "_last": F.coalesce(F.lag("hash").over(w), F.lit(""))})
    fault = F.when(F.col("seq") != F.col("_want"), "numero").when(F.col("prev") != F.col("_last"), "elo").when(F.sha2("_json", 256) != F.col("hash"), "conteudo")
    out = j.select("case_id", "seq", fault.alias("falha")).filter("falha is not null")
    if artifacts is not None:
        lost = log.filter("artifact_sha256 is not null").join(artifacts.select(F.col("sha256").alias("artifact_sha256")).distinct(), "artifact_sha256", "left_anti")
        out = out.unionByName(lost.select("case_id", "seq", F.lit("artefato").alias("falha")))
    return out


def action_counts(log: DataFrame, actions: list[str], after: int = 0) -> DataFrame:
    """One row a case with a column for each action's number of records after a sequence number."""
    return log.filter(F.col("seq") > after).groupBy("case_id").agg(*[F.count_if(F.col("action") == a).alias(a.replace(".", "_")) for a in actions])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_check(now: DataFrame, stated: DataFrame) -> DataFrame:
    """(path, falha): files missing, new or changed against a manifest."""
    j = now.select("path", F.col("sha256").alias("a")).join(stated.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return j.select("path", F.when(F.col("a").isNull(), "ausente").when(F.col("b").isNull(), "nova").when(F.col("a") != F.col("b"), "alterada").alias("falha")).filter("falha is not null")


def exposure_index(values: DataFrame, column: str) -> DataFrame:
    """(hash): the distinct hashes of values without blanks and case; values themselves aren't kept."""
    v = F.lower(F.trim(F.col(column)))
    return values.filter(v != "").select(F.sha2(v, 256).alias("hash")).distinct()


def exposed(values: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Rows whose value's hash is in the index."""
    return values.withColumn("_h", F.sha2(F.lower(F.trim(F.col(column))), 256)).join(index.select(F.col("hash").alias("_h")), "_h", "left_semi").drop("_h")
