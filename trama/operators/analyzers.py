"""Findings over registry links: intermediaries, batches, recycled lines, geography, sanctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trama.functions.constants import CLOSED

BATCH_DAYS, BATCH_LEAST, ANCHORS = 30, 3, ("telefone", "email", "pessoa", "cep")


def shared_partner(links: DataFrame, partners: DataFrame) -> DataFrame:
    """(kind, anchor) of the anchors where one partner belongs to two or more of their companies."""
    j = links.select("kind", "anchor", "root").distinct().join(partners.select("root", "person").distinct(), "root")
    return j.groupBy("kind", "anchor", "person").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("kind", "anchor").distinct()


def intermediaries(links: DataFrame, partners: DataFrame, least: int = 4) -> DataFrame:
    """(kind, anchor, empresas): anchors of at least so many establishments without any shared partner.

    links has kind, anchor, org and root, partners root and person. A partner is
    shared if they are at two or more of the establishments, units of one company included.
    """
    many = links.groupBy("kind", "anchor").agg(F.count_distinct("org").alias("empresas")).filter(F.col("empresas") >= least)
    at = links.join(many.select("kind", "anchor"), ["kind", "anchor"], "left_semi").select("kind", "anchor", "org", "root").distinct()
    per_root = at.groupBy("kind", "anchor", "root").agg(F.count(F.lit(1)).alias("n"))
    persons = per_root.join(partners.select("root", "person").distinct(), "root").groupBy("kind", "anchor", "person").agg(F.sum("n").alias("n")).filter("n >= 2")
    return many.join(persons.select("kind", "anchor").distinct(), ["kind", "anchor"], "left_anti")


def densest_window(dated: DataFrame, group: list[str], item: str, day: str, days: int = BATCH_DAYS) -> DataFrame:
    """(group, n, fim): the greatest number of items within so many days, and the first last day of such a window."""
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*group).orderBy("_d").rangeBetween(-days, 0)
    counted = dated.withColumn("_d", n).withColumn("n", F.count(F.lit(1)).over(w))
    return counted.groupBy(*group).agg(F.max(F.struct("n", (-F.col("_d")).alias("_e"))).alias("b")).select(*group, F.col("b.n").alias("n"), F.date_add(F.lit("1970-01-01").cast("date"), -F.col("b._e")).alias("fim"))


def batches(links: DataFrame, days: int = BATCH_DAYS, least: int = BATCH_LEAST) -> DataFrame:
    """(kind, anchor, empresas, inicio, fim): anchors whose companies opened in one batch.

    links has kind, anchor, root and opened (date). A company counts by its
    earliest day. Of anchors with the same set of companies the one of the first
    kind in ANCHORS, then the least, stands for all.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(ANCHORS) for x in (k, i)])
    first = links.filter("opened is not null").groupBy("kind", "anchor", "root").agg(F.min("opened").alias("opened"))
    best = densest_window(first, ["kind", "anchor"], "root", "opened", days).filter(F.col("n") >= least)
    inside = first.join(best, ["kind", "anchor"]).filter((F.col("opened") <= F.col("fim")) & (F.col("opened") >= F.date_sub("fim", days)))
    # a set is told by its size and two sums of hashes, which combine on the map side
    sets = inside.groupBy("kind", "anchor", "fim").agg(F.count(F.lit(1)).alias("empresas"), F.min("opened").alias("inicio"), F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(1), "root").cast("decimal(38,0)")).alias("s2"))
    w = Window.partitionBy("empresas", "s1", "s2").orderBy(order[F.col("kind")], "anchor")
    return sets.withColumn("k", F.row_number().over(w)).filter("k = 1").select("kind", "anchor", "empresas", "inicio", "fim")


def recycled_lines(links: DataFrame) -> DataFrame:
    """(anchor, encerradas, ativas, depois): telephones of a closed and of another company.

    links has anchor, root, status and opened. A company is closed if all its
    known statuses are; depois says that one still open began after a closed one.
    """
    s = F.trim(F.coalesce("status", F.lit("")))
    root = links.withColumn("s", F.when(s != "", s)).groupBy("anchor", "root").agg(F.bool_and(F.col("s").isin(*CLOSED)).alias("closed"), F.min("opened").alias("d0"), F.max("opened").alias("d1")).filter("closed is not null")
    g = root.groupBy("anchor").agg(
        F.count_if("closed").alias("encerradas"),
        F.count_if(~F.col("closed")).alias("ativas"),
        F.min(F.when(F.col("closed"), F.col("d0"))).alias("a"),
        F.max(F.when(~F.col("closed"), F.col("d1"))).alias("b"),
    )
    return g.filter("encerradas > 0 and ativas > 0").select("anchor", "encerradas", "ativas", F.coalesce(F.col("b") > F.col("a"), F.lit(False)).alias("depois"))


def wrong_state(links: DataFrame) -> DataFrame:
    """(phone, org, uf_telefone, uf): links of a telephone with an entity of another state; links has these columns."""
    return links.filter("uf_telefone is not null and uf is not null and uf_telefone <> upper(uf)").select("phone", "org", "uf_telefone", F.upper("uf").alias("uf")).distinct()


def region_mismatch(people: DataFrame) -> DataFrame:
    """(person, regioes, ufs): people none of whose fiscal regions is a state of their companies; people has person, regiao ARRAY, uf."""
    g = people.groupBy("person").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("regiao")))).alias("regioes"), F.array_sort(F.collect_set("uf")).alias("ufs"))
    return g.filter((F.size("regioes") > 0) & (F.size("ufs") > 0) & ~F.arrays_overlap("regioes", "ufs"))


def sanctions_in_component(members: DataFrame) -> DataFrame:
    """(componente, sancoes, alvos): components with a sanction and a target; members has componente, kind, is_target."""
    g = members.groupBy("componente").agg(F.count_if(F.col("kind") == "sancao").alias("sancoes"), F.count_if("is_target").alias("alvos"))
    return g.filter("sancoes > 0 and alvos > 0")


#: From the gravest on.
SEVERITIES = ("alta", "media", "baixa", "info")


def distinct_findings(findings: DataFrame, *order: str) -> DataFrame:
    """findings (type, entity_ids, ...), of each type and set of entities the first in order: a finding said twice counts once.

    The entities may come in any order and repeated; ties are settled by the text.
    """
    w = Window.partitionBy("type", "_who").orderBy(*order, "text")
    who = F.array_join(F.array_sort("entity_ids"), "\u0001")
    return findings.withColumn("_who", F.sha2(who, 256)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_who")
