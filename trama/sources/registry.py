"""Registry files: headerless, semicolons, quoted, Latin-1, plain or in archives; and their tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.functions.identifiers import digits
from trama.operators.tables import in_scope, keep_last, light

WIDTH = {"estabelecimento": 30, "empresa": 7, "socio": 11}
LEAST = {"estabelecimento": 28, "empresa": 6, "socio": 6}


def file_kind(name: str) -> str | None:
    """The table a file belongs to, by its name."""
    n = name.lower()
    return "estabelecimento" if "estabele" in n else "empresa" if "empre" in n else "socio" if "socio" in n else None


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Columns c0, c1, ... and n, the fields found; rows shorter than the kind needs are left out."""
    width = WIDTH[kind]
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.csv(path, sep=";", quote='"', escape='"', encoding="ISO-8859-1", schema=schema, mode="PERMISSIVE", multiLine=False)
    last = F.greatest(*[F.when(F.col(f"c{i}").isNotNull(), i + 1).otherwise(0) for i in range(width)])
    return rows.withColumn("n", last).filter(F.col("n") >= LEAST[kind]).drop("n")


def read_zip(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The same from members of archives, each streamed by the task that holds the archive."""
    width = WIDTH[kind]

    def rows(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for content in f.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as m:
                            reader = csv.reader(io.TextIOWrapper(m, "latin-1", newline=""), delimiter=";", quotechar='"')
                            batch = []
                            for r in reader:
                                if len(r) >= LEAST[kind]:
                                    batch.append((r + [None] * width)[:width])
                                if len(batch) == 10_000:
                                    yield pd.DataFrame(batch, columns=[f"c{i}" for i in range(width)], dtype=object)
                                    batch = []
                            if batch:
                                yield pd.DataFrame(batch, columns=[f"c{i}" for i in range(width)], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, ", ".join(f"c{i} string" for i in range(width)))


def phone(area: Column, number: Column) -> Column:
    """International form of a registry telephone: area of two digits, number of eight or nine; else null."""
    a, n = digits(area), digits(number)
    return F.when((F.length(a) == 2) & F.length(n).isin(8, 9), F.concat(F.lit("+55"), a, n))


def establishments(raw: DataFrame, states: list[str] | None = None, small: bool = False) -> DataFrame:
    """The establishment table from raw columns: by states, and only rows worth a small index if small."""
    c = lambda i: F.col(f"c{i}")
    e = raw.select(
        F.concat("c0", "c1", "c2").alias("cnpj"),
        c(0).alias("cnpj_basico"),
        (c(3) == "1").cast("int").alias("matriz"),
        c(4).alias("nome_fantasia"),
        c(5).alias("situacao"),
        c(19).alias("uf"),
        c(20).alias("municipio"),
        c(17).alias("bairro"),
        F.concat(F.concat_ws(" ", c(13), c(14)), F.lit(", "), c(15)).alias("logradouro"),
        c(18).alias("cep"),
        F.lower(F.trim(c(27))).alias("email"),
        phone(c(21), c(22)).alias("e164_1"),
        phone(c(23), c(24)).alias("e164_2"),
        c(10).alias("inicio"),
        c(11).alias("cnae"),
    )
    if states:
        e = e.filter(F.col("uf").isin(*check_states(states)))
    return light(e) if small else e


def companies(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("c0").alias("cnpj_basico"), F.col("c1").alias("razao_social"), F.col("c2").alias("natureza"), F.col("c4").alias("capital"), F.col("c5").alias("porte"))


def partners(raw: DataFrame) -> DataFrame:
    """Repeated rows are kept: the table has no key."""
    return raw.select(F.col("c0").alias("cnpj_basico"), F.col("c2").alias("nome"), F.col("c3").alias("doc"), F.col("c4").alias("qualificacao"), F.col("c5").alias("entrada"), F.col("c8").alias("representante"))


def check_states(states: list[str]) -> list[str]:
    from trama.functions.constants import AREA_STATE

    known = set(AREA_STATE.values())
    out = sorted({s.strip().upper() for s in states})
    if unknown := [s for s in out if s not in known]:
        raise ValueError(f"unknown states: {', '.join(unknown)}")
    return out


def build(est: DataFrame, emp: DataFrame, soc: DataFrame, order: str = "recebido_em") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of an index: last row of each key, companies and partners in the establishments' scope."""
    e = keep_last(est, ["cnpj"], [c for c in (order, "carga") if c in est.columns])
    roots = e.select("cnpj_basico")
    return e, in_scope(keep_last(emp, ["cnpj_basico"], []), roots, "cnpj_basico"), in_scope(soc, roots, "cnpj_basico")


def write(est: DataFrame, path: str) -> None:
    """Parquet by state, so that a state's query reads its folder only."""
    est.write.mode("overwrite").partitionBy("uf").option("compression", "zstd").parquet(path)
