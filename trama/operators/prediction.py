"""Groups of telephones predicted from the edges of an expansion, and their measures against a truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trama.functions import phones
from trama.functions.constants import FREE_MAIL, LEFT_OUT, REGISTERED
from trama.operators import clusters, evaluation, expansion, graph

def _kind(c: str) -> Column:
    return F.substring_index(c, ":", 1)


def heuristic_edges(edges: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(heuristica, src, dst): what each heuristic would join; components of these are its groups."""
    e = edges.select("src", "dst", "relation", "confidence")
    parts: list[DataFrame] = []

    def add(name: str, df: DataFrame) -> None:
        parts.append(df.select(F.lit(name).alias("heuristica"), "src", "dst"))

    in_kinds = lambda *k: _kind("src").isin(*k) & _kind("dst").isin(*k)
    add("cadastro", e.filter(F.col("relation").isin(*REGISTERED) & in_kinds("telefone", "organizacao")))
    company = e.filter(F.col("relation").isin(*REGISTERED, "tem_socio") & in_kinds("telefone", "organizacao", "pessoa"))
    add("societario", company)
    bare = lambda c: F.when(_kind(c) == "pessoa", F.regexp_replace(c, r" \[[^\]]*\]$", "")).otherwise(F.col(c)).alias(c)
    add("societario-so-nome", company.select(bare("src"), bare("dst")))
    domain = F.substring_index("dst", "@", -1)
    mails = e.filter((F.col("relation") == "email_declarado") & ~domain.isin(*FREE_MAIL)).select("src", F.concat(F.lit("dominio:"), domain).alias("dst"))
    lines = e.filter(F.col("relation").isin("telefone_declarado_por", "telefone_declarado") & in_kinds("telefone", "organizacao"))
    add("dominio-email", mails.unionByName(lines.select("src", "dst")))
    t = truth.select("phone").distinct().withColumn("t", phones.normalise(F.col("phone"))).select(F.concat(F.lit("telefone:"), "phone").alias("id"), "t.ddd", "t.assinante", "t.faixa")
    add("bloco", t.filter("faixa is not null").select(F.col("id").alias("src"), F.concat(F.lit("faixa:"), "faixa").alias("dst")))
    runs = clusters.sequential(t).select(F.concat(F.lit("sequencia:"), "chave").alias("dst"), F.explode("membros").alias("src"))
    add("sequencial", runs.select("src", "dst"))
    open_ = e.filter(~_kind("src").isin(*LEFT_OUT) & ~_kind("dst").isin(*LEFT_OUT))
    hubs = _hubs(e)
    pruned = open_.join(hubs.select(F.col("id").alias("src")), "src", "left_anti").join(hubs.select(F.col("id").alias("dst")), "dst", "left_anti")
    for x in thresholds:
        add(f"combinado {x}", open_.filter(F.col("confidence") >= x))
        add(f"combinado {x} podado", pruned.filter(F.col("confidence") >= x))
    return reduce(DataFrame.unionByName, parts)


def _hubs(e: DataFrame, least: int = 4) -> DataFrame:
    """(id): telephones, mails and postal codes of at least so many establishments without a shared partner."""
    near = graph.undirected(e).distinct()
    at = near.filter(_kind("node").isin("telefone", "cep", "email") & (_kind("other") == "organizacao"))
    many = at.groupBy("node").agg(F.count_distinct("other").alias("n")).filter(F.col("n") >= least)
    people = near.filter((_kind("node") == "organizacao") & (_kind("other") == "pessoa")).select(F.col("node").alias("other"), F.col("other").alias("person"))
    shared = at.join(many.select("node"), "node", "left_semi").join(people, "other").groupBy("node", "person").agg(F.count_distinct("other").alias("k")).filter("k >= 2").select("node").distinct()
    return many.join(shared, "node", "left_anti").select(F.col("node").alias("id"))


def predict(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """(heuristica, phone, previsto): all heuristics in one run of components, their entities kept apart by name."""
    h = heuristic_edges(edges, truth)
    tag = lambda c: F.concat("heuristica", F.lit("\u0001"), c)
    comp = graph.components(h.select(tag("src").alias("src"), tag("dst").alias("dst")))
    part = F.split("id", "\u0001")
    got = comp.select(part[0].alias("heuristica"), part[1].alias("e"), F.col("componente").alias("previsto")).filter(F.col("e").startswith("telefone:"))
    names = h.select("heuristica").distinct()
    every = truth.select("phone").distinct().join(names)  # the heuristics are a fixed handful
    return every.join(got.select("heuristica", F.expr("substring(e, 10)").alias("phone"), "previsto"), ["heuristica", "phone"], "left").withColumn("previsto", F.coalesce("previsto", F.concat(F.lit("so:"), "phone")))


def evaluate(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """(heuristica, mundo, vp, fp, fn, pares_previstos, precisao, revocacao, f1)."""
    j = predict(edges, truth).join(truth, "phone")
    return evaluation.precision_recall(evaluation.pair_counts(j, "phone", "previsto", "grupo", ["heuristica", "mundo"]))


def run(registry: expansion.Registry, truth: DataFrame, depth: int = 2) -> DataFrame:
    """Edges of an expansion of all telephones of a truth."""
    targets = truth.select(F.concat(F.lit("telefone:"), "phone").alias("id"))
    return expansion.edges(expansion.expand(targets, registry, depth))
