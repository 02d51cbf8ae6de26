"""Queries of the registry index: last versions, look-ups, scopes, ranges, counts, merges, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.functions import text
from trama.functions.scoring import phone_grade
from trama.operators import custody, tables
from trama.sources import recipes, registry
from trama.session import table

ORDER = ["recebido_em", "carga", "situacao", "email"]


def latest(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each establishment."""
    return tables.keep_last(table(spark, d, "estabelecimento"), ["cnpj"], ORDER)


def r_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d).select("cnpj", "situacao", "email", "carga", "recebido_em")


def r_states(spark: SparkSession, d: str) -> DataFrame:
    e = latest(spark, d)
    return e.filter(F.col("uf").isin("MG", "SP")).groupBy("uf").agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("matriz") == 1).alias("matrizes"))


def r_light(spark: SparkSession, d: str) -> DataFrame:
    return tables.light(latest(spark, d)).select("cnpj")


def r_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = latest(spark, d).filter("uf = 'MG'").select("cnpj_basico")
    return tables.in_scope(table(spark, d, "socio"), scope, "cnpj_basico").groupBy("cnpj_basico").agg(F.count(F.lit(1)).alias("socios"))


def r_out_of_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = latest(spark, d).filter("uf = 'MG'").select("cnpj_basico")
    return tables.out_of_scope(table(spark, d, "empresa"), scope, "cnpj_basico").select("cnpj_basico").distinct()


def r_phone_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Establishments for every telephone of the open registers, by either of their numbers."""
    wanted = table(spark, d, "chave").filter("tipo = 'telefone'").select(F.col("valor").alias("phone"))
    return tables.look_up(wanted, tables.phone_rows(latest(spark, d)), "phone").select("phone", "cnpj")


def r_phone_first(spark: SparkSession, d: str) -> DataFrame:
    """Of each telephone the first 200 establishments by number; the limit is part of the look-up."""
    wanted = table(spark, d, "chave").filter("tipo = 'telefone'").select(F.col("valor").alias("phone"))
    return tables.look_up(wanted, tables.phone_rows(latest(spark, d)).select("phone", "cnpj"), "phone", 200, ["cnpj"])


def r_mail_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "chave").filter("tipo = 'email'").select(F.lower("valor").alias("email"))
    return tables.look_up(wanted, latest(spark, d).withColumn("email", F.lower("email")), "email").select("email", "cnpj")


def r_company(spark: SparkSession, d: str) -> DataFrame:
    firm = table(spark, d, "empresa").groupBy("cnpj_basico").agg(F.max("razao_social").alias("razao_social"))
    return latest(spark, d).select("cnpj", "cnpj_basico").join(firm, "cnpj_basico", "left")


def r_partners(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "socio").select("cnpj_basico", "nome", "doc").distinct()
    roots = latest(spark, d).select("cnpj_basico")
    return tables.look_up(roots, s, "cnpj_basico", 200, ["nome", "doc"])


def r_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Number of other establishments of the same company, from one count a company instead of pairs."""
    e = latest(spark, d).select("cnpj", "cnpj_basico")
    n = e.groupBy("cnpj_basico").agg((F.count(F.lit(1)) - 1).alias("irmaos"))
    return e.join(n, "cnpj_basico").select("cnpj", "irmaos")


def r_by_partner(spark: SparkSession, d: str) -> DataFrame:
    """Companies of partners whose name fits a pattern."""
    s = table(spark, d, "socio").filter(F.upper(F.trim("nome")).like("%DA SERRA%") | F.upper(F.trim("nome")).like("A%A"))
    return s.select(F.upper(F.trim("nome")).alias("nome"), "cnpj_basico").distinct()


def r_inverted(spark: SparkSession, d: str) -> DataFrame:
    """Records of the open registers by key, their attributes as a map."""
    wanted = table(spark, d, "chave").select("tipo", "valor")
    hit = recipes.lookup(table(spark, d, "chave").distinct(), table(spark, d, "registro"), wanted)
    return hit.select("tipo", "valor", "id", "receita", F.col("atributos")["uf"].alias("uf"), F.col("atributos")["municipio"].alias("municipio"))


def _blocks(e: DataFrame) -> DataFrame:
    """Numbering ranges: one of ten thousand numbers for each prefix of the establishments' own numbers."""
    p = tables.phone_rows(e).select(F.substring("phone", 4, 2).alias("ddd"), F.col("phone").substr(F.lit(6), F.length("phone") - 9).alias("prefixo")).distinct()
    rows = p.select(F.col("ddd").alias("cn"), "prefixo", F.lit("").alias("faixa_inicial"), F.lit("").alias("faixa_final"), F.concat(F.lit("P"), F.col("ddd")).alias("prestadora"))
    return recipes.ranges(rows)


def r_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The carrier of every telephone by the range that holds it."""
    e = latest(spark, d)
    p = tables.phone_rows(e).select("phone").distinct().select("phone", F.substring("phone", 4, 2).alias("ddd"), F.col("phone").substr(F.lit(6), F.lit(20)).try_cast("bigint").alias("n"))
    return tables.range_join(p, _blocks(e), "ddd", "n", "inicio", "fim").select("phone", "inicio", "fim", "prestadora")


def r_roots_per_phone(spark: SparkSession, d: str) -> DataFrame:
    return tables.roots_per_phone(latest(spark, d))


def r_phone_grades(spark: SparkSession, d: str) -> DataFrame:
    return tables.rarity_links(latest(spark, d)).select("phone", "cnpj", "raizes", phone_grade(F.col("raizes"), F.col("situacao")).alias("grau"))


def r_towns(spark: SparkSession, d: str) -> DataFrame:
    """Towns with between 3 and 400 companies that have a telephone."""
    e = latest(spark, d).filter("coalesce(e164_1, e164_2) is not null")
    return e.groupBy("uf", "municipio").agg(F.count_distinct("cnpj_basico").alias("raizes")).filter(F.col("raizes").between(3, 400))


def r_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for n in ("estabelecimento", "empresa", "socio", "registro", "chave"):
        one = table(spark, d, n).agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(n).alias("tabela"), "linhas")
        out = one if out is None else out.unionByName(one)
    return out


def r_merge_states(spark: SparkSession, d: str) -> DataFrame:
    """Partners of two state extracts put together: repeated rows stay."""
    e, s = latest(spark, d), table(spark, d, "socio")
    parts = [tables.in_scope(s, e.filter(F.col("uf") == uf), "cnpj_basico") for uf in ("BA", "PR")]
    return parts[0].unionByName(parts[1]).groupBy("cnpj_basico", "nome").agg(F.count(F.lit(1)).alias("n"))


def r_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 800 companies; the size is the sample's parameter."""
    return tables.seeded_sample(table(spark, d, "empresa"), "cnpj_basico", 800, 7)


def r_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Establishments whose e-mail's hash is in the index of the open registers' e-mails."""
    index = custody.exposure_index(table(spark, d, "chave").filter("tipo = 'email'"), "valor")
    return custody.exposed(latest(spark, d).select("cnpj", "email").filter("email <> ''"), "email", index).select("cnpj")


def r_mask_match(spark: SparkSession, d: str) -> DataFrame:
    """Full numbers made of the order keys against the masks of partners: equal six middle digits."""
    k = F.lpad(((F.col("o_orderkey") * 7919 + 104729) % F.lit(10**9)).cast("string"), 9, "0")
    full = table(spark, d, "orders").select("o_orderkey", F.substring(k, 4, 6).alias("m"))
    masks = table(spark, d, "socio").filter(F.col("doc").rlike(r"^\*{3}[0-9]{6}\*{2}$")).select(F.substring("doc", 4, 6).alias("m"), "cnpj_basico").distinct()
    return full.join(masks, "m").select("o_orderkey", "cnpj_basico", "m")


def r_keys(spark: SparkSession, d: str) -> DataFrame:
    e = latest(spark, d)
    return e.select("cnpj", text.name_key(F.coalesce("logradouro", F.lit(""))).alias("endereco"), text.mail_domain(F.col("email")).alias("dominio"))


def r_raw_establishments(spark: SparkSession, d: str) -> DataFrame:
    """The establishment projection of raw columns, from valid raw records."""
    from trama.operators import parse_faults

    p = parse_faults.parse(table(spark, d, "estabelecimentos0")).filter("quoted and n = 30")
    raw = p.select(*[F.element_at("cells", i + 1).alias(f"c{i}") for i in range(30)])
    return tables.keep_last(registry.establishments(raw), ["cnpj"], ["nome_fantasia"]).select("cnpj", "matriz", "nome_fantasia", "uf", "e164_1", "email", "logradouro")


QUERIES = {f.__name__: f for f in (r_latest, r_states, r_light, r_scope, r_out_of_scope, r_phone_lookup, r_phone_first, r_mail_lookup, r_company, r_partners, r_siblings, r_by_partner, r_inverted, r_ranges, r_roots_per_phone, r_phone_grades, r_towns, r_counts, r_merge_states, r_sample, r_exposure, r_mask_match, r_keys, r_raw_establishments)}

E = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY recebido_em DESC NULLS LAST, carga DESC NULLS LAST, situacao DESC NULLS LAST, email DESC NULLS LAST) AS rn FROM estabelecimento) WHERE rn = 1)"
P = E + ", p AS (SELECT DISTINCT * FROM (SELECT e164_1 AS phone, * FROM e UNION ALL SELECT e164_2 AS phone, * FROM e) WHERE phone <> '')"
_ROOTS = "r AS (SELECT phone, count(DISTINCT cnpj_basico) AS raizes FROM p GROUP BY phone)"
_STATUS = "CASE lpad(trim(situacao), 2, '0') WHEN '01' THEN 'nula' WHEN '02' THEN 'ativa' WHEN '03' THEN 'suspensa' WHEN '04' THEN 'inapta' WHEN '08' THEN 'baixada' END"

SQL = {
    "r_latest": f"WITH {E} SELECT cnpj, situacao, email, carga, recebido_em FROM e",
    "r_states": f"WITH {E} SELECT uf, count(*) AS linhas, count(*) FILTER (matriz = 1) AS matrizes FROM e WHERE uf IN ('MG', 'SP') GROUP BY uf",
    "r_light": f"WITH {E} SELECT cnpj FROM e WHERE e164_1 <> '' OR e164_2 <> '' OR email <> '' OR matriz = 1",
    "r_scope": f"WITH {E} SELECT cnpj_basico, count(*) AS socios FROM socio WHERE cnpj_basico IN (SELECT cnpj_basico FROM e WHERE uf = 'MG') GROUP BY cnpj_basico",
    "r_out_of_scope": f"WITH {E} SELECT DISTINCT cnpj_basico FROM empresa WHERE cnpj_basico NOT IN (SELECT cnpj_basico FROM e WHERE uf = 'MG')",
    "r_phone_lookup": f"WITH {P} SELECT phone, cnpj FROM p WHERE phone IN (SELECT valor FROM chave WHERE tipo = 'telefone')",
    "r_phone_first": f"WITH {P} SELECT phone, cnpj FROM p WHERE phone IN (SELECT valor FROM chave WHERE tipo = 'telefone') QUALIFY row_number() OVER (PARTITION BY phone ORDER BY cnpj) <= 200",
    "r_mail_lookup": f"WITH {E} SELECT lower(email) AS email, cnpj FROM e WHERE lower(email) IN (SELECT lower(valor) FROM chave WHERE tipo = 'email')",
    "r_company": f"WITH {E} SELECT cnpj, cnpj_basico, razao_social FROM e LEFT JOIN (SELECT cnpj_basico, max(razao_social) AS razao_social FROM empresa GROUP BY cnpj_basico) USING (cnpj_basico)",
    "r_partners": f"WITH {E} SELECT cnpj_basico, nome, doc FROM (SELECT DISTINCT cnpj_basico, nome, doc FROM socio) WHERE cnpj_basico IN (SELECT cnpj_basico FROM e) QUALIFY row_number() OVER (PARTITION BY cnpj_basico ORDER BY nome NULLS FIRST, doc NULLS FIRST) <= 200",
    "r_siblings": f"WITH {E} SELECT cnpj, count(*) OVER (PARTITION BY cnpj_basico) - 1 AS irmaos FROM e",
    "r_by_partner": "SELECT DISTINCT upper(trim(nome)) AS nome, cnpj_basico FROM socio WHERE upper(trim(nome)) LIKE '%DA SERRA%' OR upper(trim(nome)) LIKE 'A%A'",
    "r_inverted": "SELECT c.tipo, c.valor, r.id, r.receita, json_extract_string(dados, '$.uf') AS uf, json_extract_string(dados, '$.municipio') AS municipio FROM (SELECT DISTINCT * FROM chave) c JOIN registro r ON r.id = c.registro_id WHERE c.tipo IS NOT NULL AND c.valor IS NOT NULL",
    "r_ranges": f"WITH {P}, n AS (SELECT DISTINCT phone, substr(phone, 4, 2) AS ddd, substr(phone, 6)::BIGINT AS n, substr(phone, 6, length(phone) - 9) AS prefixo FROM p), b AS (SELECT DISTINCT ddd, (prefixo || '0000')::BIGINT AS inicio, (prefixo || '9999')::BIGINT AS fim, 'P' || ddd AS prestadora FROM n) SELECT phone, inicio, fim, prestadora FROM n JOIN b ON b.ddd = n.ddd AND n BETWEEN inicio AND fim",
    "r_roots_per_phone": f"WITH {P}, {_ROOTS} SELECT * FROM r",
    "r_phone_grades": f"WITH {P}, {_ROOTS} SELECT DISTINCT phone, cnpj, raizes, 'A' || least(5, CASE WHEN raizes <= 1 THEN 2 WHEN raizes <= 3 THEN 3 WHEN raizes <= 9 THEN 4 ELSE 5 END + CASE WHEN {_STATUS} <> 'ativa' THEN 1 ELSE 0 END)::VARCHAR AS grau FROM p JOIN r USING (phone)",
    "r_towns": f"WITH {E} SELECT uf, municipio, count(DISTINCT cnpj_basico) AS raizes FROM e WHERE coalesce(e164_1, e164_2) IS NOT NULL GROUP BY uf, municipio HAVING count(DISTINCT cnpj_basico) BETWEEN 3 AND 400",
    "r_counts": " UNION ALL ".join(f"SELECT '{n}' AS tabela, count(*) AS linhas FROM {n}" for n in ("estabelecimento", "empresa", "socio", "registro", "chave")),
    "r_merge_states": f"WITH {E}, m AS (SELECT * FROM socio WHERE cnpj_basico IN (SELECT cnpj_basico FROM e WHERE uf = 'BA') UNION ALL SELECT * FROM socio WHERE cnpj_basico IN (SELECT cnpj_basico FROM e WHERE uf = 'PR')) SELECT cnpj_basico, nome, count(*) AS n FROM m GROUP BY cnpj_basico, nome",
    "r_exposure": f"WITH {E} SELECT cnpj FROM e WHERE email <> '' AND sha256(lower(trim(email))) IN (SELECT sha256(lower(trim(valor))) FROM chave WHERE tipo = 'email' AND lower(trim(valor)) <> '')",
    "r_mask_match": "SELECT o_orderkey, cnpj_basico, m FROM (SELECT o_orderkey, substr(lpad(((o_orderkey * 7919 + 104729) % 1000000000)::VARCHAR, 9, '0'), 4, 6) AS m FROM orders) JOIN (SELECT DISTINCT substr(doc, 4, 6) AS m, cnpj_basico FROM socio WHERE regexp_full_match(doc, '\\*{3}[0-9]{6}\\*{2}')) USING (m)",
    "r_keys": f"WITH {E} SELECT cnpj, regexp_replace(upper(replace(coalesce(logradouro, ''), 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS endereco, lower(string_split(email, '@')[-1]) AS dominio FROM e",
}
