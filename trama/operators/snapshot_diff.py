"""What changed between consecutive full snapshots.

Each snapshot is reduced to one canonical 128-bit hash a key; consecutive
snapshots meet in a full outer join on the key. A missing side gives an
addition or a removal, unequal hashes give a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trama.session import Work


def blank_to_null(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t != "", t)


def canonical_text(c: Column) -> Column:
    """Without outer blanks and letter case; empty is null."""
    return F.lower(blank_to_null(c))


def canonical_code(c: Column) -> Column:
    """Letters and digits only."""
    return blank_to_null(F.lower(F.regexp_replace(c, r"[^0-9A-Za-z]", "")))


def canonical_status(c: Column) -> Column:
    """Two places, with a leading zero."""
    t = canonical_text(c)
    return F.when(F.length(t) == 1, F.concat(F.lit("0"), t)).otherwise(t)


def canonical_cnpj(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))


def parse_month(c: Column) -> Column:
    """AAAA-MM from AAAA-MM[-DD], AAAAMM[DD], AAAA/MM, MM/AAAA, MM-AAAA or DD/MM/AAAA; else null."""
    t = F.trim(c)
    ymd = F.regexp_extract(t, r"^(\d{4})\D?(0[1-9]|1[0-2])(\D?\d{2}.*)?$", 1)
    ym2 = F.regexp_extract(t, r"^(\d{4})\D?(0[1-9]|1[0-2])(\D?\d{2}.*)?$", 2)
    m1 = F.regexp_extract(t, r"^(?:\d{1,2}\D)?(\d{1,2})\D(\d{4})$", 1)
    y1 = F.regexp_extract(t, r"^(?:\d{1,2}\D)?(\d{1,2})\D(\d{4})$", 2)
    return F.when(ymd != "", F.concat_ws("-", ymd, ym2)).when(y1 != "", F.concat_ws("-", y1, F.lpad(m1, 2, "0")))


def chosen_deliveries(meta: DataFrame) -> DataFrame:
    """(carga, mes, ordem): of each month the delivery built last, months numbered in order from 0.

    Of deliveries built at the same instant the greater carga holds. Deliveries
    without a readable month or instant are left out, as they can't be placed.
    """
    when = F.max(F.when(F.col("k") == "construido_em", F.expr("try_to_timestamp(trim(v))"))).alias("_t")
    month = F.max(F.when(F.col("k") == "mes_referencia", parse_month(F.col("v")))).alias("mes")
    d = meta.groupBy("carga").agg(month, when).filter(F.col("mes").isNotNull() & F.col("_t").isNotNull())
    best = d.groupBy("mes").agg(F.max_by("carga", F.struct("_t", "carga")).alias("carga"))
    return best.select("carga", "mes", (F.row_number().over(Window.orderBy("mes")) - 1).alias("ordem"))


def keyed_hashes(rows: DataFrame, group: list[str], key: str, order: str, content: dict[str, Column]) -> DataFrame:
    """One row of each (group, key), that with the greatest order, as the hashes of its content.

    content maps names to canonical expressions. Null content hashes like null,
    whatever its column. A null key is no record and is left out. Of rows with
    the same order the greatest hash holds, so the result doesn't hang on their sequence.
    """
    cols = list(content.values())
    marked = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in cols]
    row = F.struct(F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit("b"), *reversed(marked)).alias("h2"), *[c.alias(n) for n, c in content.items() if n == "situacao"])
    return rows.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(F.max(F.struct(F.col(order), row.alias("r"))).alias("_m")).select(*group, key, "_m.r.*")


def diff(hashed: DataFrame, key: str, last: int) -> DataFrame:
    """(ordem, key, mudanca, de, para) between the snapshots ordem - 1 and ordem.

    hashed has ordem, key, h1, h2, situacao; last is the greatest ordem.
    The first snapshot yields nothing; an empty input yields nothing.
    """
    cur = hashed.filter(F.col("ordem") > 0)
    old = hashed.filter(F.col("ordem") < last).select((F.col("ordem") + 1).alias("ordem"), key, F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("situacao").alias("de"))
    j = cur.join(old, ["ordem", key], "full_outer")
    kind = F.when(F.col("o1").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("h1") != F.col("o1")) | (F.col("h2") != F.col("o2")), "changed")
    return j.select("ordem", key, kind.alias("mudanca"), "de", F.col("situacao").alias("para")).filter("mudanca is not null")


def registry_changes(snap: DataFrame, meta: DataFrame) -> DataFrame:
    """(mes, cnpj, mudanca, de, para) of the monthly registry snapshots; de and para are the situacao before and after."""
    months = chosen_deliveries(meta)
    content = {
        "nome_fantasia": canonical_text(F.col("nome_fantasia")),
        "situacao": canonical_status(F.col("situacao")),
        "cep": canonical_code(F.col("cep")),
        "email": canonical_text(F.col("email")),
        "e164_1": canonical_text(F.col("e164_1")),
    }
    rows = snap.select("carga", "linha", canonical_cnpj(F.col("cnpj")).alias("cnpj"), *[c.alias(n) for n, c in content.items()])
    # one row a month, and one row: bounded by the months delivered
    placed = rows.join(F.broadcast(months.select("carga", "ordem")), "carga")
    # written once, for it is read as the snapshot of a month and as the one before the next
    hashed = Work(snap.sparkSession, "snapshots").save(keyed_hashes(placed, ["ordem"], "cnpj", "linha", {n: F.col(n) for n in content}), "hashed", last=F.coalesce(F.max("ordem"), F.lit(0)))
    out = diff(hashed, "cnpj", hashed.figures["last"])
    return out.join(F.broadcast(months.select("ordem", "mes")), "ordem").select("mes", "cnpj", "mudanca", "de", "para")
