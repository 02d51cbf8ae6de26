"""Prebuilt registry indexes: export by state with a manifest, and import after checking it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.operators import custody
from trama.operators.tables import in_scope
from trama.sources.registry import check_states

TABLES = ("estabelecimento", "empresa", "socio")


def export(spark: SparkSession, tables: dict[str, DataFrame], path: str, state: str | None = None) -> dict:
    """Writes the three tables, cut to a state if one is given, and manifest.json with rows and hashes of all files.

    Companies and partners without an establishment in the cut are left out.
    """
    est = tables["estabelecimento"]
    if state:
        est = est.filter(F.col("uf") == check_states([state])[0])
    cut = {"estabelecimento": est, "empresa": in_scope(tables["empresa"], est, "cnpj_basico"), "socio": in_scope(tables["socio"], est, "cnpj_basico")}
    out: dict = {"uf": state, "tabelas": {}}
    for name in TABLES:
        to = f"{path}/{name}"
        cut[name].write.mode("overwrite").option("compression", "zstd").parquet(to)
        files = custody.manifest(spark, to).filter(F.col("path").endswith(".parquet")).collect()
        out["tabelas"][name] = {"linhas": spark.read.parquet(to).count(), "pecas": {r["path"]: r["sha256"] for r in files}}
    (Path(path) / "manifest.json").write_text(json.dumps(out, indent=1, sort_keys=True), encoding="utf-8")
    return out


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export whose files all agree with its manifest; else ValueError."""
    stated = json.loads((Path(path) / "manifest.json").read_text(encoding="utf-8"))
    out = {}
    for name in TABLES:
        t = stated["tabelas"][name]
        now = custody.manifest(spark, f"{path}/{name}").filter(F.col("path").endswith(".parquet"))
        want = spark.createDataFrame([(k, v) for k, v in t["pecas"].items()], "path string, sha256 string")
        if faults := custody.manifest_check(now, want).collect():
            raise ValueError(f"{name}: {faults[0]['path']} {faults[0]['falha']}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    if stated["tabelas"]["estabelecimento"]["linhas"] == 0:
        raise ValueError("an index without establishments")
    return out
