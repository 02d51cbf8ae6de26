"""The engine's front: a case with scope and legal basis, and its investigation from search value to claims.

No scope, no expansion: a case expands its own targets, and further entities only
where its scope names them. Every step is entered in the custody log. Source
categories outside the landed tables don't exist here, and no switch adds them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.functions.text import target_kind
from trama.operators import analyzers, claims, clusters, custody, expansion, graph


class OutOfScope(Exception):
    pass


@dataclass
class Case:
    """A case: who asks, on what legal basis, until when, and what is in scope."""

    id: str
    actor: str
    legal_basis: str
    expires_at: str
    scope: list[str] = field(default_factory=list)
    targets: list[tuple[str, str]] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.legal_basis.strip():
            raise ValueError("a case needs a legal basis")

    def enter(self, action: str, target: str = "", summary: str = "") -> None:
        custody.append(self.log, ts=datetime.now(timezone.utc).isoformat(timespec="seconds"), case_id=self.id, actor=self.actor, action=action, target=target, summary=summary)

    def authorise(self, value: str) -> None:
        """Refuses what isn't in scope: equal to an entry, or below a domain that is one. Substrings don't count."""
        if datetime.fromisoformat(self.expires_at) < datetime.now(timezone.utc):
            self.enter("escopo.recusado", value, "expirado")
            raise OutOfScope(f"{self.id} has expired")
        if not any(value == s or value.endswith("." + s) for s in self.scope):
            self.enter("escopo.recusado", value)
            raise OutOfScope(value)

    def add_target(self, spark: SparkSession, value: str) -> tuple[str, str]:
        """Recognises a search value, puts it in scope and among the targets."""
        t = spark.range(1).select(target_kind(F.lit(value)).alias("t")).first()["t"]
        self.scope.append(t["valor"])
        self.targets.append((t["tipo"], t["valor"]))
        self.enter("alvo.incluido", t["valor"], t["tipo"])
        return t["tipo"], t["valor"]


@dataclass
class Result:
    """The tables of an investigation, lazily evaluated."""

    edges: DataFrame
    evidence: DataFrame
    claims: DataFrame
    clusters: DataFrame
    bridges: DataFrame


def investigate(spark: SparkSession, case: Case, registry: expansion.Registry, depth: int = 1, widen: bool = False) -> Result:
    """Expands a case's targets to edges, claims, clusters and bridges.

    Further levels expand only what is in scope, unless widen puts what is found
    in scope too; that is entered in the log.
    """
    for _, value in case.targets:
        case.authorise(value)
    ids = [(f"{kind}:{value}",) for kind, value in case.targets]
    targets = spark.createDataFrame(ids, "id string")
    scope = None if widen else spark.createDataFrame([(f"{k}:{s}",) for s in case.scope for k in ("telefone", "email", "documento")] or [("",)], "id string")
    case.enter("coleta.inicio", summary=f"depth {depth}, widen {widen}")
    evidence = expansion.expand(targets, registry, depth, scope)
    edges = expansion.edges(evidence)
    kinds = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("value"))
    from trama.functions.phones import normalise

    lines = kinds.filter("kind = 'telefone'").withColumn("t", normalise(F.col("value"))).select("id", "t.ddd", "t.assinante", "t.faixa")
    near = graph.undirected(edges, "confidence")
    case.enter("coleta.fim")
    return Result(edges, evidence, claims.derive(edges), clusters.all_clusters(kinds, lines, near), graph.bridges(edges, targets, max(2, 2 * depth + 2)))


def findings(edges: DataFrame, establishments: DataFrame) -> DataFrame:
    """(type, text, entity_ids, analyzer) of the analyzers over an investigation's edges."""
    from trama.functions.text import flexible_date

    e = establishments.select(F.concat(F.lit("organizacao:"), "cnpj").alias("org"), F.col("cnpj_basico").alias("root"), F.col("situacao").alias("status"), flexible_date(F.col("inicio")).alias("opened"))
    near = graph.undirected(edges).distinct()
    links = near.filter(F.col("other").startswith("organizacao:")).select(F.substring_index("node", ":", 1).alias("kind"), F.col("node").alias("anchor"), F.col("other").alias("org")).filter(F.col("kind").isin("telefone", "email", "cep", "pessoa")).join(e, "org")
    people = near.filter(F.col("node").startswith("organizacao:") & F.col("other").startswith("pessoa:")).select(F.col("node").alias("org"), F.col("other").alias("person")).join(e.select("org", "root"), "org").select("root", "person").distinct()
    hubs = analyzers.intermediaries(links.filter("kind <> 'pessoa'"), people).select(F.lit("intermediario-provavel").alias("type"), F.concat_ws(" ", "anchor", "empresas").alias("text"), F.array("anchor").alias("entity_ids"), F.lit("intermediarios").alias("analyzer"))
    lots = analyzers.batches(links).select(F.lit("lote-de-registro").alias("type"), F.concat_ws(" ", "anchor", "empresas", F.col("inicio").cast("string"), F.col("fim").cast("string")).alias("text"), F.array("anchor").alias("entity_ids"), F.lit("lote-de-registro").alias("analyzer"))
    lines = analyzers.recycled_lines(links.filter("kind = 'telefone'")).select(F.lit("linha-possivelmente-reciclada").alias("type"), F.concat_ws(" ", "anchor", "encerradas", "ativas").alias("text"), F.array("anchor").alias("entity_ids"), F.lit("reuso-de-linha").alias("analyzer"))
    return hubs.unionByName(lots).unionByName(lines)
