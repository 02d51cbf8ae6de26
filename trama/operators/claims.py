"""Claims from edges and findings, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trama.functions.scoring import level
from trama.functions.text import claim_id


def derive(edges: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(id, tipo, texto, evidencias, origem, confianca, nivel) of edges at or above least, and of findings."""
    e = edges.filter(F.col("confidence") >= least).select(
        claim_id(F.lit("vinculo"), F.col("id")).alias("id"),
        F.lit("vinculo").alias("tipo"),
        F.concat_ws(" ", "src", "relation", "dst").alias("texto"),
        F.array("id").alias("evidencias"),
        F.lit("grafo").alias("origem"),
        F.col("confidence").alias("confianca"),
        level(F.col("confidence")).alias("nivel"),
    )
    if findings is None:
        return e
    f = findings.select(claim_id(F.col("type"), F.array_join(F.array_sort("entity_ids"), ",")).alias("id"), F.col("type").alias("tipo"), F.col("text").alias("texto"), F.col("entity_ids").alias("evidencias"), F.concat(F.lit("analisador:"), "analyzer").alias("origem"), F.lit(None).cast("double").alias("confianca"), F.lit(None).cast("string").alias("nivel"))
    return e.unionByName(f)


def validate(claims: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, falha): claims of edges without evidence, with evidence that is no edge, or on an edge without source."""
    mine = claims.filter("origem = 'grafo'")
    bare = mine.filter(F.size("evidencias") == 0).select("id", F.lit("sem evidencia").alias("falha"))
    each = mine.select("id", F.explode("evidencias").alias("e"))
    lost = each.join(edges.select(F.col("id").alias("e")), "e", "left_anti").select("id", F.lit("evidencia inexistente").alias("falha"))
    known = each.join(edges.select(F.col("id").alias("e")), "e", "left_semi")
    sourceless = known.join(evidence.select(F.col("edge_id").alias("e")).distinct(), "e", "left_anti").select("id", F.lit("aresta sem fonte").alias("falha"))
    return bare.unionByName(lost).unionByName(sourceless)
