"""Measures of predicted groups: pairs, precision and recall, calibration."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the reliability bins; all but the last are open above.
BINS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)


def pair_counts(items: DataFrame, item: str, predicted: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """(by, vp, fp, fn, pares_previstos): pairs of items in one predicted and one actual group.

    Pairs are counted from group sizes, n(n-1)/2, and never listed: a pair is
    right if both groups agree, so right pairs are those of the groups of
    (predicted, actual). A group of any size costs one row.
    """
    by = by or []
    d = items.select(*by, item, predicted, actual).distinct()
    pairs = lambda n: n * (n - 1) / 2
    cell = d.groupBy(*by, predicted, actual).agg(F.count(F.lit(1)).alias("n"))
    tp = cell.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("vp"))
    pp = cell.filter(F.col(predicted).isNotNull()).groupBy(*by, predicted).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("pares_previstos"))
    ap = cell.filter(F.col(actual).isNotNull()).groupBy(*by, actual).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("reais"))
    if by:
        j = tp.join(pp, by, "full_outer").join(ap, by, "full_outer")
    else:
        j = tp.crossJoin(pp).crossJoin(ap)  # one row each
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("bigint")
    return j.select(*by, v("vp").alias("vp"), (v("pares_previstos") - v("vp")).alias("fp"), (v("reais") - v("vp")).alias("fn"), v("pares_previstos").alias("pares_previstos"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Adds precisao, revocacao and f1 at four decimals; an empty denominator gives 1."""
    p = F.when(F.col("vp") + F.col("fp") == 0, 1.0).otherwise(F.col("vp") / (F.col("vp") + F.col("fp")))
    r = F.when(F.col("vp") + F.col("fn") == 0, 1.0).otherwise(F.col("vp") / (F.col("vp") + F.col("fn")))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.withColumns({"precisao": F.round(p, 4), "revocacao": F.round(r, 4), "f1": F.round(f, 4)})


def reliability(rows: DataFrame, score: str, hit: str, bins: tuple[float, ...] = BINS) -> DataFrame:
    """(faixa, n, confianca_media, precisao_observada) of each bin that holds rows."""
    bin_ = F.lit(None).cast("string")
    for low, high in reversed(list(zip(bins, bins[1:]))):
        inside = (F.col(score) >= low) & (F.col(score) <= high if high == bins[-1] else F.col(score) < high)
        bin_ = F.when(inside, f"{low:.1f}-{high:.1f}").otherwise(bin_)
    g = rows.withColumn("faixa", bin_).filter("faixa is not null").groupBy("faixa")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("confianca_media"), F.round(F.avg(F.col(hit).cast("double")), 4).alias("precisao_observada"))


def calibration_error(table: DataFrame) -> DataFrame:
    """(ece): mean gap between confidence and precision, weighted by rows."""
    return table.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confianca_media") - F.col("precisao_observada"))), F.sum("n")), F.lit(0.0)), 4).alias("ece"))


def isotonic(rows: DataFrame, score: str, hit: str) -> list[tuple[float, float]]:
    """Steps (upper limit, value) of the non-decreasing fit, by pooling neighbours that fall.

    Ties of the score are merged in Spark, rounded to four decimals as scores
    are, so at most 10 001 rows come to the driver.
    """
    g = rows.groupBy(F.round(score, 4).alias("x")).agg(F.sum(F.col(hit).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("x").collect()
    pools: list[list[float]] = []
    for r in g:
        pools.append([r["x"], r["s"], r["n"]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            x, s, n = pools.pop()
            pools[-1] = [x, pools[-1][1] + s, pools[-1][2] + n]
    return [(round(x, 4), round(s / n, 4)) for x, s, n in pools]


def apply_steps_column(value: Column, steps: list[tuple[float, float]]) -> Column:
    """apply_steps() as a column expression; null stays null."""
    if not steps:
        return value
    out = F.lit(steps[-1][1])
    for limit, fitted in reversed(steps[:-1]):
        out = F.when(value <= limit, fitted).otherwise(out)
    return F.when(value.isNotNull(), out)


def apply_steps(value: float, steps: list[tuple[float, float]]) -> float:
    """The value of the first step whose limit isn't below; beyond all the last; without steps the input."""
    if not steps:
        return value
    i = bisect.bisect_left([x for x, _ in steps], value)
    return steps[min(i, len(steps) - 1)][1]


def mean_and_spread(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column at four decimals."""
    return rows.groupBy(*by).agg(*[x for c in columns for x in (F.round(F.avg(c), 4).alias(f"{c}_media"), F.round(F.stddev_pop(c), 4).alias(f"{c}_desvio"))])


def best_configuration(rows: DataFrame, name: str) -> DataFrame:
    """(name, f1, precisao) of the best row by f1, then precision, then the least name."""
    return rows.orderBy(F.desc("f1"), F.desc("precisao"), name).select(name, "f1", "precisao").limit(1)
