"""Queries that expand targets through the registry into scored edges: the engine's main task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.operators import expansion
from trama.plans.registry import P, latest
from trama.plans.sqltext import area_state
from trama.session import table


def registry(spark: SparkSession, d: str) -> expansion.Registry:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return expansion.Registry(latest(spark, d), table(spark, d, "empresa"), table(spark, d, "socio"), texts)


def targets(spark: SparkSession, d: str) -> DataFrame:
    """The telephones and e-mails of the open registers."""
    k = table(spark, d, "chave").filter("valor is not null and tipo in ('telefone', 'email')")
    return k.select(F.concat_ws(":", "tipo", F.when(F.col("tipo") == "email", F.lower("valor")).otherwise(F.col("valor"))).alias("id")).distinct()


def x_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one level around all keys of the open registers."""
    e = expansion.edges(expansion.expand(targets(spark, d), registry(spark, d), 0))
    return e.select("src", "relation", "dst", "confidence", "nivel", "corroboracoes")


def x_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """Two more levels around the e-mails of the open registers, telephones in the scope of the case only."""
    t = targets(spark, d).filter("id like 'email:%'")
    scope = targets(spark, d).filter("id like 'telefone:%'")
    return expansion.expand(t, registry(spark, d), 2, scope).groupBy("relation", "nivel").agg(F.count(F.lit(1)).alias("n"))


def x_mentions(spark: SparkSession, d: str) -> DataFrame:
    """What every document mentions."""
    docs = table(spark, d, "documents")
    t = docs.select(F.concat(F.lit("documento:"), F.col("doc_id").cast("string")).alias("id"))
    return expansion.text_evidence(t, docs.select(F.col("doc_id").alias("id"), "text")).select("src", "dst")


QUERIES = {f.__name__: f for f in (x_edges, x_two_levels, x_mentions)}

_STATUS = "CASE lpad(trim(situacao), 2, '0') WHEN '01' THEN 'nula' WHEN '02' THEN 'ativa' WHEN '03' THEN 'suspensa' WHEN '04' THEN 'inapta' WHEN '08' THEN 'baixada' END"
_GRADE = f"least(5, CASE WHEN raizes <= 1 THEN 2 WHEN raizes <= 3 THEN 3 WHEN raizes <= 9 THEN 4 ELSE 5 END + CASE WHEN {_STATUS} <> 'ativa' THEN 1 ELSE 0 END)"

SQL = {
    "x_edges": f"""WITH {P}, r AS (SELECT phone, count(DISTINCT cnpj_basico) AS raizes FROM p GROUP BY phone),
      t AS (SELECT DISTINCT tipo || ':' || CASE WHEN tipo = 'email' THEN lower(valor) ELSE valor END AS id FROM chave WHERE valor IS NOT NULL AND tipo IN ('telefone', 'email')),
      h AS (SELECT DISTINCT 'telefone:' || phone AS id, cnpj FROM p WHERE 'telefone:' || phone IN (SELECT id FROM t) UNION SELECT 'email:' || lower(email), cnpj FROM e WHERE email <> '' AND 'email:' || lower(email) IN (SELECT id FROM t)),
      a AS (SELECT h.id, e.* FROM h JOIN e USING (cnpj)), f AS (SELECT DISTINCT cnpj, cnpj_basico, situacao, regexp_replace(cep, '[^0-9]', '', 'g') AS cep, email, e164_1, e164_2 FROM a),
      q AS (SELECT DISTINCT cnpj_basico, upper(trim(nome)) || CASE WHEN regexp_full_match(trim(doc), '\\*{{3}}[0-9]{{6}}\\*{{2}}') THEN ' [' || trim(doc) || ']' ELSE '' END AS person, trim(doc) AS doc FROM socio WHERE nome <> ''),
      v AS (SELECT id AS src, 'telefone_declarado_por' AS relation, 'organizacao:' || cnpj AS dst, {_GRADE} AS g, cnpj AS note FROM a JOIN r ON a.id = 'telefone:' || r.phone
        UNION SELECT id, 'telefone_declarado_por', 'organizacao:' || cnpj, 2, cnpj FROM a WHERE id LIKE 'email:%'
        UNION SELECT 'organizacao:' || cnpj, 'endereco_no_cep', 'cep:' || cep, 2, cnpj FROM f WHERE cep <> ''
        UNION SELECT 'organizacao:' || cnpj, 'email_declarado', 'email:' || lower(email), 2, cnpj FROM f WHERE email <> ''
        UNION SELECT 'organizacao:' || cnpj, 'telefone_declarado', 'telefone:' || phone, {_GRADE}, cnpj FROM (SELECT cnpj, situacao, unnest([e164_1, e164_2]) AS phone FROM f) l JOIN r USING (phone) WHERE phone <> '' AND (cnpj, 'telefone:' || phone) NOT IN (SELECT (cnpj, id) FROM h)
        UNION SELECT 'organizacao:' || cnpj, 'tem_socio', 'pessoa:' || person, 2, cnpj FROM f JOIN q USING (cnpj_basico)
        UNION SELECT 'pessoa:' || person, 'documento_parcial', 'cpf-parcial:' || doc, 2, cnpj FROM f JOIN q USING (cnpj_basico) WHERE doc <> ''
        UNION SELECT 'organizacao:' || f.cnpj, 'mesmo_grupo_cadastral', 'organizacao:' || e.cnpj, 2, f.cnpj FROM f JOIN e USING (cnpj_basico) WHERE e.cnpj <> f.cnpj
        UNION SELECT id, 'pertence_ao_bloco', 'faixa:' || left(d, 7), 4, '' FROM (SELECT id, CASE WHEN length(x) IN (12, 13) AND left(x, 2) = '55' THEN substr(x, 3) WHEN left(x, 1) = '0' AND length(x) IN (11, 12) THEN substr(x, 2) ELSE x END AS d FROM (SELECT id, regexp_replace(id, '[^0-9]', '', 'g') AS x FROM t WHERE id LIKE 'telefone:%')) WHERE length(d) IN (10, 11) AND {area_state('left(d, 2)')} IS NOT NULL),
      s AS (SELECT src, relation, dst, round(max(0.95 * CASE g WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 ELSE 0.2 END::DOUBLE), 4) AS confidence, count(*) AS corroboracoes FROM v GROUP BY ALL)
      SELECT src, relation, dst, confidence, CASE WHEN confidence >= 0.75 THEN 'alta' WHEN confidence >= 0.5 THEN 'media' WHEN confidence >= 0.25 THEN 'baixa' ELSE 'indiciaria' END AS nivel, corroboracoes FROM s""",
}
