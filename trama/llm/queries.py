"""Queries of the linkage and text problems, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.llm import addresses, bpe, components, encoding, language, linkage, mixing
from trama.session import Work, table


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matches(linkage.link(*[table(spark, d, n) for n in ("registro", "chave", "estabelecimento", "empresa")]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("registro_id", "cnpj")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_ids(table(spark, d, "aresta"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("grupo").agg(F.count(F.lit(1)).alias("entidades"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    firms, places = table(spark, d, "empresa"), table(spark, d, "estabelecimento")
    triples = encoding.model([firms, places], [["razao_social"], ["nome_fantasia", "logradouro"]])
    parts = [encoding.find(f.withColumn("id", F.col(key)), triples, ["id"], c).select(F.lit(name).alias("tabela"), "id", F.lit(c).alias("campo"), "texto", "restaurado", "restavel") for f, name, key, c in ((firms, "empresa", "cnpj_basico", "razao_social"), (places, "estabelecimento", "cnpj", "nome_fantasia"), (places, "estabelecimento", "cnpj", "logradouro"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("tabela", "id", "campo").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).distinct()


def _same_place(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "estabelecimento")
    triples = encoding.model([places], [["logradouro"]])
    shared = spark.sparkContext.broadcast(triples)
    return addresses.same_place(places, repair=lambda: encoding.repairer(shared))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _same_place(spark, d).select("cnpj_a", "cnpj_b")


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    return _same_place(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


#: The configuration of this project's mixtures: the domain of each source it names. "fonte-inexistente" delivers nothing.
DOMAINS = {
    "oficial": "diario-oficial boletim-mercosul boletim-europa press-releases comex",
    "registral": "certidoes notas-cartorio legado arquivo-morto leiloes minutas fonte-inexistente",
    "analise": "atas relint forum rascunhos",
    "correspondencia": "correspondencia telegramas bilhetes chamados",
}


def _mixed(spark: SparkSession, d: str, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    return mixing.select(table(spark, d, "documents"), table(spark, d, "mistura"), _domains(spark), total)


def _domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k) for k, names in DOMAINS.items() for s in names.split()], "source string, dominio string")


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_shares_exact(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, "exact")[1]


def p9_budgets_chars(spark: SparkSession, d: str) -> DataFrame:
    """The budgets of the same tree with sizes in characters, which SQL can work out too."""
    docs = table(spark, d, "documents").select("source", "lang", F.length("text").cast("bigint").alias("tokens"))
    plan = mixing.planned(mixing.leaf_table(table(spark, d, "mistura"), mixing.source_sizes(docs), _domains(spark)))
    rows = [(r["mistura"], r["source"], r["idioma"], int(r["tokens"]), round(float(r["budget"]), 3)) for r in plan]
    return spark.createDataFrame(rows, "mistura string, source string, idioma string, caracteres bigint, orcamento double")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return Work(spark, "language").save(language.sentences(docs, language.model(docs)), "segments")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_or_mixed(_segments(spark, d)).select("doc_id", "par", "lang")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.documents_language(_segments(spark, d))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).filter("lang is not null").select("doc_id", "par", "lang", "palavras", "confianca")


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_sizes, p3_found, p3_restored, p4_found, p4_weights, p8_ids, p9_uses, p9_shares, p9_shares_exact, p9_budgets_chars, p10_found, p10_documents, p10_segments)}

_GROUPS = """
WITH RECURSIVE ok AS (SELECT origem AS a, destino AS b FROM aresta WHERE origem <> '' AND destino <> ''),
e AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok UNION SELECT a, a FROM ok UNION SELECT b, b FROM ok),
g(v, m) USING KEY (v) AS (
  SELECT a, min(b) FROM e GROUP BY a
  UNION
  SELECT e.b, min(g.m) FROM g JOIN e ON e.a = g.v JOIN recurring.g AS old ON old.v = e.b WHERE g.m < old.m GROUP BY e.b)
SELECT v AS entidade, m AS grupo FROM g
"""



def _poured(level: str, above: str, parent: str, child: str) -> str:
    """SQL that shares the amount of each row of above (keyed by parent) among the rows of level by weight up to cap."""
    by = f"PARTITION BY {parent} ORDER BY cap / w, {child}"
    return f"""
SELECT {parent}, {child}, CASE WHEN w <= 0 OR cap <= 0 THEN 0 ELSE least(cap, w * lam) END AS amount FROM (
  SELECT *, max(CASE WHEN w > 0 AND cap > 0 AND low <= amount THEN (amount - before) / rest END) OVER (PARTITION BY {parent}) AS lam FROM (
    SELECT l.*, amount, before, rest, before + rest * lag(cap / w, 1, 0.0) OVER ({by}) AS low FROM (
      SELECT *, coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {level} WHERE w > 0 AND cap > 0) l
    JOIN {above} USING ({parent}))
  UNION ALL BY NAME SELECT *, 0.0 AS amount, 0.0 AS before, 1.0 AS rest, 0.0 AS low FROM {level} WHERE NOT (w > 0 AND cap > 0))"""


def _budgets_sql() -> str:
    labels = " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in language._LABEL.items())
    folded = "translate(lower(trim(lang)), 'áàâãäçéèêëíìîïñóòôõöúùûü', 'aaaaaceeeeiiiinooooouuuu')"
    domains = ", ".join(f"('{s}', '{k}')" for k, names in DOMAINS.items() for s in names.split())
    return f"""
WITH docs AS (SELECT source, coalesce(CASE regexp_extract(regexp_replace({folded}, '[\u0300-\u036f]', '', 'g'), '^([a-z]+)(?:[^a-z].*)?$', 1, 's') {labels} END, '') AS idioma, length(text) AS t
  FROM documents WHERE length(text) > 0 AND source IS NOT NULL),
by_lang AS (SELECT source, idioma, sum(t) AS t FROM docs GROUP BY ALL),
sizes AS (SELECT source, arg_max(idioma, (idioma <> '', t, idioma)) AS idioma, sum(t) AS t FROM by_lang GROUP BY source),
leaf AS (SELECT m.mistura AS k0, coalesce(dominio, '') AS k1, coalesce(idioma, '') AS k2, m.source AS k3, coalesce(t, 0) AS t, greatest(peso, 0) AS w, coalesce(t, 0) * greatest(reps, 0)::DOUBLE AS cap
  FROM (SELECT mistura, source, max(peso) AS peso, max(max_repeticoes) AS reps FROM mistura GROUP BY ALL) m
  LEFT JOIN sizes USING (source) LEFT JOIN (VALUES {domains}) d(source, dominio) USING (source)),
a0 AS (SELECT k0, least(sum(t) FILTER (w > 0), sum(cap) FILTER (w > 0))::DOUBLE AS amount FROM leaf GROUP BY k0),
l1 AS (SELECT k0, k1, sum(w) AS w, coalesce(sum(cap) FILTER (w > 0), 0) AS cap FROM leaf GROUP BY ALL),
a1 AS (SELECT k0 || '/' || k1 AS p1, amount FROM ({_poured("l1", "a0", "k0", "k1")})),
l2 AS (SELECT k0 || '/' || k1 AS p1, k2, sum(w) AS w, coalesce(sum(cap) FILTER (w > 0), 0) AS cap FROM leaf GROUP BY ALL),
a2 AS (SELECT p1 || '/' || k2 AS p2, amount FROM ({_poured("l2", "a1", "p1", "k2")})),
l3 AS (SELECT k0 || '/' || k1 || '/' || k2 AS p2, k3, w, cap FROM leaf),
a3 AS ({_poured("l3", "a2", "p2", "k3")})
SELECT k0 AS mistura, leaf.k3 AS source, k2 AS idioma, t::BIGINT AS caracteres, round(amount, 3) AS orcamento
FROM leaf JOIN a3 ON a3.p2 = k0 || '/' || k1 || '/' || k2 AND a3.k3 = leaf.k3"""


SQL = {
    "p2_found": _GROUPS,
    "p9_budgets_chars": _budgets_sql(),
    "p2_sizes": f"SELECT grupo, count(*) AS entidades FROM ({_GROUPS}) GROUP BY grupo",
}
