"""Groups of telephones and mails, as DataFrame operators with keys, members and strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trama.functions.constants import FREE_MAIL

COLUMNS = ("tipo", "chave", "membros", "forca")


def _cluster(kind, key, members, strength) -> list:
    return [kind.alias("tipo") if not isinstance(kind, str) else F.lit(kind).alias("tipo"), key.alias("chave"), members.alias("membros"), strength.alias("forca")]


def by_block(phones: DataFrame) -> DataFrame:
    """phones (id, faixa): two or more numbers of one numbering block."""
    g = phones.filter("faixa is not null").groupBy("faixa").agg(F.array_sort(F.collect_set("id")).alias("m")).filter(F.size("m") >= 2)
    return g.select(*_cluster("bloco-numeracao", F.col("faixa"), F.col("m"), F.lit(0.35)))


def islands(rows: DataFrame, group: str, number: str, tie: str, gap: int) -> DataFrame:
    """Adds ilha: runs of numbers in a group whose neighbours are at most gap apart, counted from 0."""
    w = Window.partitionBy(group).orderBy(number, tie)
    far = (F.col(number) - F.lag(number).over(w)) > gap
    return rows.withColumn("ilha", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sequential(phones: DataFrame, gap: int = 20) -> DataFrame:
    """phones (id, ddd, assinante): runs of two or more numbers with gaps of at most gap."""
    p = phones.filter("ddd is not null").withColumn("n", F.col("assinante").try_cast("bigint")).filter("n is not null").dropDuplicates(["id"])
    g = islands(p, "ddd", "n", "id", gap).groupBy("ddd", "ilha").agg(F.array_sort(F.collect_set("id")).alias("m"), F.min_by("assinante", F.struct("n", "id")).alias("a")).filter(F.size("m") >= 2)
    return g.select(*_cluster("numeracao-sequencial", F.concat_ws("-", "ddd", "a"), F.col("m"), F.lit(0.55)))


def by_mail_domain(mails: DataFrame, free: tuple[str, ...] = FREE_MAIL) -> DataFrame:
    """mails (id, value): two or more addresses of one domain (after the first @); weak where anyone may have one (free)."""
    m = mails.filter(F.col("value").contains("@")).withColumn("d", F.lower(F.expr("substring(value, instr(value, '@') + 1)")))
    g = m.groupBy("d").agg(F.array_sort(F.collect_set("id")).alias("m")).filter(F.size("m") >= 2)
    return g.select(*_cluster("dominio-email", F.col("d"), F.col("m"), F.when(F.col("d").isin(*free), 0.25).otherwise(0.70)))


def by_anchor(entities: DataFrame, near: DataFrame, kinds: tuple[str, ...] = ("organizacao", "cnpj", "dominio", "endereco", "pessoa")) -> DataFrame:
    """near (node, other, confidence) is the undirected edge view: two or more telephones at one anchor.

    Strength is half plus half the mean confidence of all edges to telephones, at most 0.95.
    """
    anchors = entities.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("node"), "kind", "value")
    phones = entities.filter("kind = 'telefone'").select(F.col("id").alias("other"))
    g = near.join(phones, "other", "left_semi").join(anchors, "node").groupBy("node", "kind", "value").agg(F.array_sort(F.collect_set("other")).alias("m"), F.round(F.avg(F.col("confidence").cast("decimal(12,6)")), 4).alias("c")).filter(F.size("m") >= 2)
    return g.select(*_cluster(F.concat(F.lit("ancora-"), "kind"), F.col("value"), F.array_sort(F.array_append("m", F.col("node"))), F.round(F.least(F.lit(0.95).cast("decimal(8,6)"), (F.lit(0.5) + F.col("c").cast("double") / 2).cast("decimal(8,6)")), 4).cast("double")))


def all_clusters(entities: DataFrame, phones: DataFrame, near: DataFrame) -> DataFrame:
    """The clusters of all kinds; tables.positions() ranks them."""
    mails = entities.filter("kind = 'email'")
    return by_anchor(entities, near).unionByName(sequential(phones)).unionByName(by_mail_domain(mails)).unionByName(by_block(phones))
