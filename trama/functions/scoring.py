"""Grades of evidence, their combination, and levels of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trama.functions.constants import CREDIBILITY, RELIABILITY, STATUS


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def grade_score(grade: Column) -> Column:
    """Weight of a grade of letter and number; an unreadable one counts as F6."""
    g = F.upper(F.trim(grade))
    ok = F.coalesce(F.length(g) == 2, F.lit(False))
    letter = F.when(ok, F.coalesce(_map(RELIABILITY)[F.substring(g, 1, 1)], F.lit(RELIABILITY["F"]))).otherwise(RELIABILITY["F"])
    number = F.when(ok, F.coalesce(_map(CREDIBILITY)[F.substring(g, 2, 1)], F.lit(CREDIBILITY["6"]))).otherwise(CREDIBILITY["6"])
    return F.round(letter * number, 4)


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "alta").when(score >= 0.50, "media").when(score >= 0.25, "baixa").otherwise("indiciaria")


def phone_grade(roots: Column, status: Column) -> Column:
    """Grade of a registry telephone by how many companies declare it; one worse where the registration isn't active."""
    base = F.when(roots <= 1, 2).when(roots <= 3, 3).when(roots <= 9, 4).otherwise(5)
    name = _map(STATUS)[F.lpad(F.trim(status), 2, "0")]
    worse = F.coalesce(name != "ativa", F.lit(False))
    return F.concat(F.lit("A"), F.least(F.lit(5), base + worse.cast("int")).cast("string"))


def noisy_or(scores: DataFrame, keys: list[str], source: str, score: str) -> DataFrame:
    """(keys, confianca, fontes, corroboracoes): the best score of each source, combined as 1 - prod(1 - s).

    Scores are held to [0, 1], the result to 0.99, at four decimals. Repeats of a
    source don't raise the result. Null scores count for nothing. Both steps
    combine on the map side, so an edge with very many rows is no burden.
    """
    best = scores.groupBy(*keys, source).agg(F.max(score).alias("_s"), F.count(F.lit(1)).alias("_n"))
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_s", F.lit(0.0))))
    return best.groupBy(*keys).agg(
        F.round(F.least(F.lit(0.99), 1.0 - F.product(1.0 - clip)), 4).alias("confianca"),
        F.count(source).alias("fontes"),
        F.sum("_n").alias("corroboracoes"),
    )
