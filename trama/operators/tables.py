"""Relational operators of the registry index: look-ups, scopes, merges, ranges, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trama.session import Work


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; ties by all columns, so the result is one whatever the sequence."""
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rest]).alias("_r"))).alias("_m"))
    return packed.select(*keys, "_m._r.*").select(*rows.columns)


def phone_rows(establishments: DataFrame, phones: list[str] = ("e164_1", "e164_2")) -> DataFrame:
    """(phone, columns): one row for each telephone, so that a look-up by either is one equi-join."""
    listed = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(p) != "", F.col(p)) for p in phones])))
    return establishments.withColumn("phone", F.explode(listed))


def look_up(wanted: DataFrame, table: DataFrame, key: str, per_key: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of table for the keys wanted; with per_key the first so many of each key by order."""
    hit = table.join(wanted.select(key).distinct(), key, "left_semi")
    if per_key is None:
        return hit
    w = Window.partitionBy(key).orderBy(*(order or [c for c in table.columns if c != key]))
    return hit.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_key).drop("_n")


def roots_per_phone(establishments: DataFrame) -> DataFrame:
    """(phone, raizes): exact number of companies that declare each telephone, in either column."""
    return phone_rows(establishments).select("phone", "cnpj_basico").distinct().groupBy("phone").agg(F.count(F.lit(1)).alias("raizes"))


def in_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return rows.join(scope.select(key).distinct(), key, "left_semi")


def out_of_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in scope; a null key is never in it, so it stays."""
    return rows.join(scope.select(key).distinct(), key, "left_anti")


def light(establishments: DataFrame) -> DataFrame:
    """Rows worth keeping in a small index: with a contact, or headquarters."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return establishments.filter(some("e164_1") | some("e164_2") | some("email") | (F.coalesce("matriz", F.lit(0)) == 1))


def range_join(points: DataFrame, ranges: DataFrame, key: str, value: str, low: str, high: str, width: int = 10_000) -> DataFrame:
    """points joined with the ranges of their key that hold value, ends included.

    Both sides are cut into bins of width: a range has a row for each bin it
    touches, a point one, so the join is an equi-join on (key, bin) with the
    bounds as residual, whatever the size of either side.
    """
    p = points.withColumn("_bin", F.floor(F.col(value) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [key, "_bin"]).filter(F.col(value).between(F.col(low), F.col(high))).drop("_bin")


def snapshot_delta(old: DataFrame, new: DataFrame, key: str, value: str, least: float = 0.05) -> DataFrame:
    """(key, mudanca, de, para): keys only in one of two runs, and values that differ by at least so much."""
    j = old.select(key, F.col(value).alias("de")).join(new.select(key, F.col(value).alias("para")), key, "full_outer")
    kind = F.when(F.col("de").isNull(), "nova").when(F.col("para").isNull(), "perdida").when(F.abs(F.col("para") - F.col("de")) >= least, "alterada")
    return j.select(key, kind.alias("mudanca"), "de", "para").filter("mudanca is not null")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n distinct keys in the order of their seeded hash: the same for the same seed, however rows lie."""
    return rows.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def top(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def rarity_links(establishments: DataFrame) -> DataFrame:
    """(phone, cnpj, raizes, situacao): every declared telephone with the number of companies that declare it."""
    e = phone_rows(establishments).select("phone", "cnpj", "situacao").distinct()
    return e.join(roots_per_phone(establishments), "phone")


#: The orders in which results are given: descending where marked by "-". A tie has an order too, by the last columns.
ORDERS = {
    "clusters": ("-forca", "tipo", "chave"),
    "correlation": ("-confidence", "entidade", "relation", "vinculada_a", "tipo_vinculo"),
    "claims": ("-confianca", "id"),
    "bridges": ("saltos", "-elo_mais_fraco", "de", "para"),
    "components": ("-tamanho", "componente"),
}


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows with posicao, from 1, in the order of the columns named ("-" descending; nulls last).

    Rows are sorted by ranges over all tasks and written; only the number of rows of each range comes to the driver.
    """
    work = Work(rows.sparkSession, "positions")
    by = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in order]
    ranged = work.save(rows.orderBy(*by).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "_p bigint, _before bigint")
    return ranged.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn("posicao", F.col("_before") + inside + 1).drop("_m", "_p", "_before")
