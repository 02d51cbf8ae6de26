"""Expansion of targets through the registry, level by level, into entities and evidence.

A level joins its whole frontier at once; every edge comes with its source's
grade, and edges seen from several sources are combined by noisy-or. Only
entities in scope are expanded when a scope is given, and full numbers of persons
found in texts enter as masks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trama.functions import identifiers as ids
from trama.functions import phones, scoring, text
from trama.operators.tables import phone_rows, roots_per_phone
from trama.session import Work

EVIDENCE = "src string, relation string, dst string, collector string, grade string, note string"


@dataclass
class Registry:
    """The tables that targets are expanded through; each may hold any number of rows."""

    establishments: DataFrame
    companies: DataFrame
    partners: DataFrame
    texts: DataFrame | None = None


def entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def _row(src: Column, relation: str, dst: Column, grade: Column | str, note: Column | str, collector: str = "cnpj-reverso") -> list[Column]:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return [src.alias("src"), F.lit(relation).alias("relation"), dst.alias("dst"), F.lit(collector).alias("collector"), lit(grade).alias("grade"), lit(note).alias("note")]


def block_evidence(frontier: DataFrame) -> DataFrame:
    """Each telephone of the frontier and its numbering block: a weak sign."""
    p = frontier.filter(F.col("id").startswith("telefone:")).withColumn("t", phones.normalise(F.expr("substring(id, 10)")))
    return p.filter("t.faixa is not null").select(*_row(F.col("id"), "pertence_ao_bloco", entity("faixa", F.col("t.faixa")), "A4", "bloco de numeracao", "nucleo"))


def text_evidence(frontier: DataFrame, texts: DataFrame) -> DataFrame:
    """Telephones, e-mails and identifiers that the frontier's documents mention; texts has id and text."""
    t = texts.select(entity("documento", F.col("id").cast("string")).alias("id"), "text").join(frontier.select("id"), "id", "left_semi")
    found = F.concat(
        F.transform(phones.find(F.col("text")), lambda x: entity("telefone", x["chave"])),
        F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0)), lambda m: entity("email", m)),
        F.transform(
            F.filter(ids.find_documents(F.col("text")), lambda x: ~x["ambiguo"]),
            lambda x: F.when(x["tipo"] == "cpf", entity("cpf-parcial", F.concat(F.lit("***"), F.substring(x["valor"], 4, 6), F.lit("**")))).when(x["tipo"] == "cnpj", entity("organizacao", x["valor"])).otherwise(F.concat(x["tipo"], F.lit(":"), x["valor"])),
        ),
    )
    return t.select("id", F.explode(F.array_distinct(found)).alias("dst")).select(*_row(F.col("id"), "menciona", F.col("dst"), "B2", "texto", "extrator"))


def registry_evidence(frontier: DataFrame, reg: Registry, work: Work, level: int) -> DataFrame:
    """What the registry says of the frontier's telephones and e-mails and of the establishments they lead to."""
    e = reg.establishments
    by_phone = phone_rows(e).select(entity("telefone", F.col("phone")).alias("id"), "cnpj")
    by_mail = e.filter("email <> ''").select(entity("email", F.lower("email")).alias("id"), "cnpj")
    hit = by_phone.unionByName(by_mail).join(frontier.select("id"), "id", "left_semi").distinct()
    cols = ["cnpj", "cnpj_basico", "situacao", "cep", "email", "e164_1", "e164_2", "logradouro"]
    at = work.save(hit.join(e.select(*cols), "cnpj"), f"hits{level}")
    roots = roots_per_phone(e)
    org = entity("organizacao", F.col("cnpj"))
    note = F.concat(F.lit("cnpj "), F.col("cnpj"))
    of_phone = at.filter(F.col("id").startswith("telefone:")).withColumn("phone", F.expr("substring(id, 10)")).join(roots, "phone")
    of_mail = at.filter(F.col("id").startswith("email:"))
    out = of_phone.select(*_row(F.col("id"), "telefone_declarado_por", org, scoring.phone_grade(F.col("raizes"), F.col("situacao")), note))
    out = out.unionByName(of_mail.select(*_row(F.col("id"), "telefone_declarado_por", org, "A2", note)))
    firms = at.select(*cols).distinct()
    code = ids.digits(F.col("cep"))
    out = out.unionByName(firms.filter(code != "").select(*_row(org, "endereco_no_cep", entity("cep", code), "A2", note)))
    out = out.unionByName(firms.filter("email <> ''").select(*_row(org, "email_declarado", entity("email", F.lower("email")), "A2", note)))
    lines = phone_rows(firms).join(roots, "phone").join(at.select("cnpj", F.expr("substring(id, 10)").alias("phone")), ["cnpj", "phone"], "left_anti")
    out = out.unionByName(lines.select(*_row(org, "telefone_declarado", entity("telefone", F.col("phone")), scoring.phone_grade(F.col("raizes"), F.col("situacao")), note)))
    people = reg.partners.filter("nome <> ''").select("cnpj_basico", text.person_key(F.col("nome"), F.col("doc")).alias("p"), F.trim("doc").alias("doc")).distinct()
    at_firm = firms.select("cnpj", "cnpj_basico").join(people, "cnpj_basico")
    out = out.unionByName(at_firm.select(*_row(org, "tem_socio", entity("pessoa", F.col("p")), "A2", note)))
    out = out.unionByName(at_firm.filter("doc <> ''").select(*_row(entity("pessoa", F.col("p")), "documento_parcial", entity("cpf-parcial", F.col("doc")), "A2", note)))
    units = e.select(F.col("cnpj").alias("u"), "cnpj_basico")
    return out.unionByName(firms.select("cnpj", "cnpj_basico").join(units, "cnpj_basico").filter("u <> cnpj").select(*_row(org, "mesmo_grupo_cadastral", entity("organizacao", F.col("u")), "A2", note)))


def expand(targets: DataFrame, reg: Registry, depth: int = 1, scope: DataFrame | None = None) -> DataFrame:
    """The evidence (src, relation, dst, collector, grade, note, nivel) within depth levels of the targets (id).

    Level 0 expands the targets, each next one the entities seen for the first
    time. With a scope (id) later levels expand only what is in it. Evidence
    given twice counts once. No targets, no evidence.
    """
    work = Work(targets.sparkSession, "expand")
    seen = work.save(targets.select("id").filter("id is not null").distinct(), "targets")
    frontier, all_rows = seen, None
    for level in range(depth + 1):
        new = block_evidence(frontier).unionByName(registry_evidence(frontier, reg, work, level))
        if reg.texts is not None:
            new = new.unionByName(text_evidence(frontier, reg.texts))
        new = work.save(new.distinct().withColumn("nivel", F.lit(level)), f"evidence{level}")
        all_rows = new if all_rows is None else all_rows.unionByName(new)
        if level == depth:
            break
        ends = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = work.save(ends if scope is None else ends.join(scope.select("id"), "id", "left_semi"), f"frontier{level + 1}")
        if frontier.isEmpty():
            break
        seen = work.save(seen.unionByName(ends), f"seen{level + 1}")
    first = all_rows.groupBy("src", "relation", "dst", "collector", "grade", "note").agg(F.min("nivel").alias("nivel"))
    return first


def edges(evidence: DataFrame) -> DataFrame:
    """(id, src, relation, dst, confidence, fontes, corroboracoes, nivel) of the evidence."""
    e = scoring.noisy_or(evidence.withColumn("s", scoring.grade_score(F.col("grade"))), ["src", "relation", "dst"], "collector", "s")
    return e.select(F.concat_ws("|", "src", "relation", "dst").alias("id"), "src", "relation", "dst", F.col("confianca").alias("confidence"), "fontes", "corroboracoes", scoring.level(F.col("confianca")).alias("nivel"))
