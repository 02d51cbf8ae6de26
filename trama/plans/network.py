"""Queries of the link graph: edges, confidence, components, paths, clusters, findings, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.functions import phones, scoring, text
from trama.functions.constants import FREE_MAIL
from trama.functions.identifiers import cpf_region, digits, postcode_state
from trama.operators import analyzers, claims, clusters, graph, tables
from trama.plans.registry import E, P, latest
from trama.plans.sqltext import area_state, flexible_date, mask_region, postcode_state as sql_state
from trama.session import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """The given links as edges: src, dst, relation, confidence, with null and empty ends left out."""
    a = table(spark, d, "aresta").filter("origem <> '' and destino <> ''")
    return a.select(F.col("origem").alias("src"), F.col("destino").alias("dst"), F.col("relacao").alias("relation"), F.col("confianca").alias("confidence"), "coletores", "ts")


def _best(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("src", "dst", "relation").agg(F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence")).withColumn("id", F.concat_ws("|", "src", "relation", "dst"))


def g_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Noisy-or over the sources of each edge."""
    s = _edges(spark, d).withColumn("coletor", F.explode(F.split("coletores", ","))).withColumn("c", F.when(~F.isnan("confidence"), F.col("confidence")))
    return scoring.noisy_or(s, ["src", "relation", "dst"], "coletor", "c").select("src", "relation", "dst", F.round("confianca", 3).alias("confianca"), "fontes", "corroboracoes")


def g_degree(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    firms = latest(spark, d).select(F.concat(F.lit("cnpj:"), "cnpj").alias("id"))
    return graph.degree(ends.unionByName(firms).distinct(), e)


def g_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d))


def g_strong_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over edges of 0.6 and more, addresses of kind fact left out."""
    e = _best(spark, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.substring_index("id", ":", 1))
    return graph.filtered_components(ids, e, F.col("confidence") >= 0.6, F.col("kind").isin("cnpj", "telefone"))


def g_levels(spark: SparkSession, d: str) -> DataFrame:
    """Everything within three hops of the headquarters in DF, as in the SQL; g_levels_sampled takes the whole table."""
    seeds = latest(spark, d).filter("uf = 'DF' and matriz = 1").select(F.concat(F.lit("cnpj:"), "cnpj").alias("id"))
    return graph.levels(_edges(spark, d), seeds, 3).select("origem", "id", "nivel")


def g_bridges(spark: SparkSession, d: str) -> DataFrame:
    seeds = latest(spark, d).filter("uf in ('DF', 'TO') and matriz = 1").select(F.concat(F.lit("cnpj:"), "cnpj").alias("id"))
    return graph.bridges(_best(spark, d), seeds, 4).select("de", "para", "saltos")


def _hundredth(spark: SparkSession, d: str) -> DataFrame:
    """Every establishment of the whole table whose number is divisible by 100."""
    return latest(spark, d).filter(F.col("cnpj").rlike("^[0-9]*00$")).select(F.concat(F.lit("cnpj:"), "cnpj").alias("id"))


def g_levels_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Everything within three hops of the establishments with numbers divisible by 100, in all states."""
    return graph.levels(_edges(spark, d), _hundredth(spark, d), 3).select("origem", "id", "nivel")


def g_bridges_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Ways of up to four hops between establishments with numbers divisible by 100, in all states."""
    return graph.bridges(_best(spark, d), _hundredth(spark, d), 4).select("de", "para", "saltos")


def g_merge(spark: SparkSession, d: str) -> DataFrame:
    """Versions of an establishment merged: last value that is there, first name, any headquarters."""
    e = table(spark, d, "estabelecimento").withColumn("seq", F.struct("recebido_em", "carga", "situacao", "email")).withColumn("hq", F.col("matriz") == 1)
    m = graph.merge_entities(e, "cnpj", "seq", ["situacao", "email", "uf"], "nome_fantasia", "hq")
    return m.select("cnpj", "situacao", "email", "uf", "hq")


def g_evidence(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "aresta").filter("origem <> '' and destino <> ''")
    first = graph.merge_evidence(a, ["origem", "relacao", "destino", "coletores", "observacao"], ["ts", "caso", "confianca", "corroboracoes"])
    return first.groupBy("origem", "relacao", "destino").agg(F.count(F.lit(1)).alias("corroboracoes"))


def g_histogram(spark: SparkSession, d: str) -> DataFrame:
    ends = _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.groupBy(F.substring_index("id", ":", 1).alias("tipo")).agg(F.count(F.lit(1)).alias("n"))


def g_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = _best(spark, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("value"))
    a = table(spark, d, "aresta").filter("origem <> '' and destino <> ''")
    ev = a.select(F.concat_ws("|", "origem", "relacao", "destino").alias("edge_id"), F.lit("A2").alias("grade"), F.col("coletores").alias("collector"), F.col("observacao").alias("note"), F.col("ts").alias("seq"))
    return graph.correlation_table(e, ids, ev).select("entidade", "tipo", "relation", "vinculada_a", "tipo_vinculo", "corroboracoes", "graus", "coletores")


def g_claims(spark: SparkSession, d: str) -> DataFrame:
    return claims.derive(_best(spark, d)).select("id", "texto", F.round("confianca", 4).alias("confianca"), "nivel")


def g_claim_faults(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all edges checked against the evidence of those with sources named."""
    e = _best(spark, d)
    ev = table(spark, d, "aresta").filter("coletores like '%indice%'").select(F.concat_ws("|", "origem", "relacao", "destino").alias("edge_id"))
    return claims.validate(claims.derive(e, least=0.0), e, ev)


def g_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The 220 entities with most edges, a report's limit."""
    return tables.top(g_degree(spark, d), 220, F.desc("grau"), "id")


def _phones(spark: SparkSession, d: str) -> DataFrame:
    p = tables.phone_rows(latest(spark, d)).select("phone").distinct().withColumn("t", phones.normalise(F.col("phone")))
    return p.filter("t.valido").select(F.concat(F.lit("telefone:"), "phone").alias("id"), "t.ddd", "t.assinante", "t.faixa")


def _short(c: DataFrame) -> DataFrame:
    return c.select("tipo", "chave", F.size("membros").alias("membros"), F.array_join("membros", ",").alias("lista"), "forca")


def g_block_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _short(clusters.by_block(_phones(spark, d)))


def g_sequential_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _short(clusters.sequential(_phones(spark, d)))


#: Providers of the test tables that anyone may use.
_FREE_HERE = ("correiolivre.test", "webcarta.test", "mailgratis.test", "caixapostal.test")


def g_domain_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = latest(spark, d).filter("email is not null").select(F.concat(F.lit("email:"), "email").alias("id"), F.col("email").alias("value")).distinct()
    return clusters.by_mail_domain(m, (*FREE_MAIL, *_FREE_HERE)).select("tipo", "chave", F.size("membros").alias("membros"), "forca")


def g_anchor_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = _best(spark, d).na.fill(0.0, ["confidence"])
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("value"))
    return clusters.by_anchor(ids, graph.undirected(e, "confidence")).select("tipo", "chave", F.size("membros").alias("membros"), F.array_join("membros", ",").alias("lista"), "forca")


def g_claims_ranked(spark: SparkSession, d: str) -> DataFrame:
    return tables.positions(claims.derive(_best(spark, d)).select("id", F.round("confianca", 4).alias("confianca")), *tables.ORDERS["claims"])


def g_components_ranked(spark: SparkSession, d: str) -> DataFrame:
    sizes = g_components(spark, d).groupBy("componente").agg(F.count(F.lit(1)).alias("tamanho"))
    return tables.positions(sizes, *tables.ORDERS["components"])


def g_clusters_ranked(spark: SparkSession, d: str) -> DataFrame:
    c = g_block_clusters(spark, d).unionByName(g_sequential_clusters(spark, d)).select("tipo", "chave", "forca").unionByName(g_domain_clusters(spark, d).select("tipo", "chave", "forca"))
    return tables.positions(c, *tables.ORDERS["clusters"])


def g_findings(spark: SparkSession, d: str) -> DataFrame:
    """Lines declared in another state, said once for each line, company and kind."""
    w = g_wrong_state(spark, d)
    f = w.select(F.lit("uf").alias("type"), F.concat_ws(" ", "phone", "uf_telefone", "uf").alias("text"), F.array("phone", F.substring("org", 1, 8)).alias("entity_ids"))
    f = f.unionByName(f.select("type", F.concat(F.lit("~"), "text").alias("text"), F.reverse("entity_ids").alias("entity_ids")))
    return analyzers.distinct_findings(f).select("type", "text")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(kind, anchor, org, root, status, opened, uf): telephones, mails and postal codes of establishments."""
    e = latest(spark, d).withColumn("opened", text.flexible_date(F.col("inicio")))
    a = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("anchor")) for k, v in (("telefone", F.col("e164_1")), ("telefone", F.col("e164_2")), ("email", F.lower("email")), ("cep", digits(F.col("cep"))))])
    return e.select(F.explode(a).alias("a"), F.col("cnpj").alias("org"), F.col("cnpj_basico").alias("root"), F.col("situacao").alias("status"), "opened", "uf").select("a.*", "org", "root", "status", "opened", "uf").filter("anchor <> ''").distinct()


def _partners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "socio").filter("nome <> ''").select(F.col("cnpj_basico").alias("root"), text.person_key(F.col("nome"), F.col("doc")).alias("person")).distinct()


def g_intermediaries(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.intermediaries(_links(spark, d), _partners(spark, d))


def g_shared_partner(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.shared_partner(_links(spark, d), _partners(spark, d))


def g_batches(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.batches(_links(spark, d))


def g_recycled(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.recycled_lines(_links(spark, d).filter("kind = 'telefone'"))


def g_wrong_state(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d).filter("kind = 'telefone'").select(F.col("anchor").alias("phone"), "org", phones.area_state(F.substring("anchor", 4, 2)).alias("uf_telefone"), "uf")
    return analyzers.wrong_state(links)


def g_wrong_postcode(spark: SparkSession, d: str) -> DataFrame:
    e = latest(spark, d).select("cnpj", "uf", postcode_state(F.col("cep")).alias("uf_cep"))
    return e.filter("uf_cep is not null and uf_cep <> uf").select("cnpj", "uf", "uf_cep")


def g_region(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "socio").filter("nome <> ''").select("cnpj_basico", text.person_key(F.col("nome"), F.col("doc")).alias("person"), cpf_region(F.col("doc")).alias("regiao")).distinct()
    e = latest(spark, d).select("cnpj_basico", "uf").distinct()
    r = analyzers.region_mismatch(s.join(e, "cnpj_basico"))
    return r.select("person", F.array_join("regioes", ",").alias("regioes"), F.array_join("ufs", ",").alias("ufs"))


def g_sanctions(spark: SparkSession, d: str) -> DataFrame:
    """Components with a closed establishment (standing for a sanction) and a headquarters as target."""
    c = g_components(spark, d)
    e = latest(spark, d).select(F.concat(F.lit("cnpj:"), "cnpj").alias("id"), F.when(F.col("situacao") == "08", "sancao").otherwise("organizacao").alias("kind"), (F.coalesce("matriz", F.lit(0)) == 1).alias("is_target"))
    return analyzers.sanctions_in_component(c.join(e, "id"))


def g_delta(spark: SparkSession, d: str) -> DataFrame:
    """What two runs (links up to, and of all, May 2025) differ in."""
    e = _edges(spark, d).withColumn("c", F.when(~F.isnan("confidence"), F.col("confidence"))).withColumn("k", F.concat_ws("|", "src", "relation", "dst"))
    old = e.filter("ts < timestamp '2025-05-01'").groupBy("k").agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("c"))
    new = e.filter("ts >= timestamp '2025-04-01'").groupBy("k").agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("c"))
    return tables.snapshot_delta(old, new, "k", "c")


QUERIES = {f.__name__: f for f in (g_confidence, g_degree, g_components, g_strong_components, g_levels, g_bridges, g_levels_sampled, g_bridges_sampled, g_merge, g_evidence, g_histogram, g_correlation, g_claims, g_claim_faults, g_ranking, g_block_clusters, g_sequential_clusters, g_domain_clusters, g_anchor_clusters, g_claims_ranked, g_components_ranked, g_clusters_ranked, g_findings, g_intermediaries, g_shared_partner, g_batches, g_recycled, g_wrong_state, g_wrong_postcode, g_region, g_sanctions, g_delta)}

_OK = "a AS (SELECT origem AS src, destino AS dst, relacao AS relation, CASE WHEN NOT isnan(confianca) THEN confianca END AS c, coletores, observacao, ts FROM aresta WHERE origem <> '' AND destino <> '')"
_BEST = _OK + ", b AS (SELECT src, dst, relation, max(c) AS c, concat_ws('|', src, relation, dst) AS id FROM a GROUP BY src, dst, relation)"


def _components_sql(edges: str) -> str:
    return f"""e2 AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges} UNION SELECT src, src FROM {edges} UNION SELECT dst, dst FROM {edges}),
    g(v, m) USING KEY (v) AS (SELECT a, min(b) FROM e2 GROUP BY a UNION
      SELECT e2.b, min(g.m) FROM g JOIN e2 ON e2.a = g.v JOIN recurring.g AS old ON old.v = e2.b WHERE g.m < old.m GROUP BY e2.b)"""


def _levels_sql(seeds: str, depth: int) -> str:
    parts = [f"n AS (SELECT src AS x, dst AS y FROM a UNION SELECT dst, src FROM a), l0 AS (SELECT DISTINCT 'cnpj:' || cnpj AS id, 'cnpj:' || cnpj AS origem, 0 AS nivel FROM e WHERE {seeds})"]
    for k in range(1, depth + 1):
        parts.append(f"l{k} AS (SELECT * FROM l{k - 1} UNION ALL SELECT DISTINCT y, origem, {k} FROM l{k - 1} JOIN n ON x = id WHERE nivel = {k - 1} AND (y, origem) NOT IN (SELECT (id, origem) FROM l{k - 1}))")
    return ", ".join(parts)


_LINKS = E + f""", s AS (SELECT cnpj AS org, cnpj_basico AS root, situacao AS status, uf, {flexible_date('inicio')} AS opened, e164_1, e164_2, email, cep FROM e),
  k AS (SELECT DISTINCT * FROM (SELECT 'telefone' AS kind, e164_1 AS anchor, org, root, status, opened, uf FROM s UNION ALL SELECT 'telefone', e164_2, org, root, status, opened, uf FROM s
        UNION ALL SELECT 'email', lower(email), org, root, status, opened, uf FROM s UNION ALL SELECT 'cep', regexp_replace(cep, '[^0-9]', '', 'g'), org, root, status, opened, uf FROM s) WHERE anchor <> ''),
  q AS (SELECT DISTINCT cnpj_basico AS root, upper(trim(nome)) || CASE WHEN regexp_full_match(trim(doc), '\\*{{3}}[0-9]{{6}}\\*{{2}}') THEN ' [' || trim(doc) || ']' ELSE '' END AS person FROM socio WHERE nome <> '')"""
_TELS = P + """, t AS (SELECT DISTINCT phone, substr(phone, 4, 2) AS ddd, substr(phone, 6) AS s FROM p),
  f AS (SELECT 'telefone:' || phone AS id, ddd, s, ddd || substr(s, 1, 5) AS faixa FROM t WHERE """ + area_state("ddd") + """ IS NOT NULL AND ((length(s) = 9 AND left(s, 1) = '9') OR (length(s) = 8 AND left(s, 1) BETWEEN '2' AND '9')))"""

SQL = {
    "g_confidence": f"WITH {_OK}, s AS (SELECT src, relation, dst, unnest(string_split(coletores, ',')) AS coletor, c FROM a), m AS (SELECT src, relation, dst, coletor, coalesce(max(c), 0) AS c, count(*) AS n FROM s GROUP BY ALL) SELECT src, relation, dst, round(round(least(0.99, 1 - product(1 - least(1, greatest(0, c)))), 4), 3) AS confianca, count(coletor) AS fontes, sum(n)::BIGINT AS corroboracoes FROM m GROUP BY src, relation, dst",
    "g_degree": f"WITH {E}, {_OK}, x AS (SELECT src AS id FROM a UNION ALL SELECT dst FROM a), i AS (SELECT id FROM x UNION SELECT 'cnpj:' || cnpj FROM e) SELECT i.id, count(x.id) AS grau FROM i LEFT JOIN x ON x.id = i.id GROUP BY i.id",
    "g_components": f"WITH RECURSIVE {_OK}, {_components_sql('a')} SELECT v AS id, m AS componente FROM g",
    "g_strong_components": f"WITH RECURSIVE {_BEST}, h AS (SELECT * FROM b WHERE c >= 0.6 AND split_part(src, ':', 1) IN ('cnpj', 'telefone') AND split_part(dst, ':', 1) IN ('cnpj', 'telefone')), {_components_sql('h')} SELECT v AS id, m AS componente FROM g",
    "g_levels": f"WITH {E}, {_OK}, {_levels_sql('uf = ' + repr('DF') + ' AND matriz = 1', 3)} SELECT origem, id, nivel FROM l3",
    "g_bridges": f"WITH {E}, {_OK}, {_levels_sql('uf IN (' + repr('DF') + ', ' + repr('TO') + ') AND matriz = 1', 4)} SELECT origem AS de, id AS para, nivel AS saltos FROM l4 WHERE origem < id AND nivel > 0 AND id IN (SELECT id FROM l0)",
    "g_merge": "SELECT cnpj, arg_max(situacao, (recebido_em, coalesce(carga, -1), coalesce(situacao, ''), coalesce(email, ''))) FILTER (situacao <> '') AS situacao, arg_max(email, (recebido_em, coalesce(carga, -1), coalesce(situacao, ''), coalesce(email, ''))) FILTER (email <> '') AS email, arg_max(uf, (recebido_em, coalesce(carga, -1), coalesce(situacao, ''), coalesce(email, ''))) FILTER (uf <> '') AS uf, bool_or(coalesce(matriz = 1, false)) AS hq FROM estabelecimento GROUP BY cnpj",
    "g_evidence": "SELECT origem, relacao, destino, count(*) AS corroboracoes FROM (SELECT DISTINCT origem, relacao, destino, coletores, observacao FROM aresta WHERE origem <> '' AND destino <> '') GROUP BY origem, relacao, destino",
    "g_histogram": f"WITH {_OK} SELECT split_part(id, ':', 1) AS tipo, count(*) AS n FROM (SELECT src AS id FROM a UNION SELECT dst FROM a) GROUP BY 1",
    "g_correlation": f"WITH {_OK} SELECT substr(src, instr(src, ':') + 1) AS entidade, split_part(src, ':', 1) AS tipo, relation, substr(dst, instr(dst, ':') + 1) AS vinculada_a, split_part(dst, ':', 1) AS tipo_vinculo, count(*) AS corroboracoes, 'A2' AS graus, string_agg(DISTINCT coletores, ';' ORDER BY coletores) AS coletores FROM a GROUP BY src, relation, dst",
    "g_claims": f"WITH {_BEST} SELECT 'C-' || left(sha256('vinculo|' || id), 10) AS id, concat_ws(' ', src, relation, dst) AS texto, round(c, 4) AS confianca, CASE WHEN c >= 0.75 THEN 'alta' ELSE 'media' END AS nivel FROM b WHERE c >= 0.5",
    "g_claim_faults": f"WITH {_BEST} SELECT 'C-' || left(sha256('vinculo|' || id), 10) AS id, 'aresta sem fonte' AS falha FROM b WHERE c >= 0 AND id NOT IN (SELECT id FROM (SELECT concat_ws('|', origem, relacao, destino) AS id FROM aresta WHERE coletores LIKE '%indice%'))",
    "g_ranking": f"WITH {E}, {_OK}, x AS (SELECT src AS id FROM a UNION ALL SELECT dst FROM a) SELECT id, count(*) AS grau FROM x GROUP BY id ORDER BY grau DESC, id LIMIT 220",
    "g_block_clusters": f"WITH {_TELS} SELECT 'bloco-numeracao' AS tipo, faixa AS chave, count(*)::INTEGER AS membros, string_agg(id, ',' ORDER BY id) AS lista, 0.35::DOUBLE AS forca FROM f GROUP BY faixa HAVING count(*) >= 2",
    "g_sequential_clusters": f"WITH {_TELS}, w AS (SELECT *, s::BIGINT - lag(s::BIGINT) OVER (PARTITION BY ddd ORDER BY s::BIGINT, id) > 20 AS far FROM f), i AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY ddd ORDER BY s::BIGINT, id ROWS UNBOUNDED PRECEDING) AS ilha FROM w) SELECT 'numeracao-sequencial' AS tipo, ddd || '-' || arg_min(s, (s::BIGINT, id)) AS chave, count(*)::INTEGER AS membros, string_agg(id, ',' ORDER BY id) AS lista, 0.55::DOUBLE AS forca FROM i GROUP BY ddd, ilha HAVING count(*) >= 2",
    "g_domain_clusters": f"WITH {E} SELECT 'dominio-email' AS tipo, lower(substr(email, instr(email, '@') + 1)) AS chave, count(DISTINCT email)::INTEGER AS membros, CASE WHEN lower(substr(email, instr(email, '@') + 1)) IN {(*FREE_MAIL, *_FREE_HERE)} THEN 0.25 ELSE 0.7 END::DOUBLE AS forca FROM e WHERE email LIKE '%@%' GROUP BY 2 HAVING count(DISTINCT email) >= 2",
    "g_anchor_clusters": f"WITH {_BEST}, n AS (SELECT src AS x, dst AS y, coalesce(c, 0) AS c FROM b UNION ALL SELECT dst, src, coalesce(c, 0) FROM b) SELECT 'ancora-cnpj' AS tipo, substr(x, 6) AS chave, (count(DISTINCT y) + 1)::INTEGER AS membros, array_to_string(list_sort(list_append(list(DISTINCT y), x)), ',') AS lista, least(9500, 5000 + ((2 * sum(round(c * 10000)::BIGINT) + count(*)) // (2 * count(*)) + 1) // 2) / 10000 AS forca FROM n WHERE split_part(x, ':', 1) = 'cnpj' AND split_part(y, ':', 1) = 'telefone' GROUP BY x HAVING count(DISTINCT y) >= 2",
    "g_intermediaries": f"WITH {_LINKS}, m AS (SELECT kind, anchor, count(DISTINCT org) AS empresas FROM k GROUP BY kind, anchor HAVING count(DISTINCT org) >= 4), c AS (SELECT DISTINCT kind, anchor FROM (SELECT kind, anchor, person FROM (SELECT DISTINCT kind, anchor, org, root FROM k) JOIN q USING (root) GROUP BY ALL HAVING count(DISTINCT org) >= 2)) SELECT m.* FROM m ANTI JOIN c ON c.kind = m.kind AND c.anchor = m.anchor",
    "g_shared_partner": f"WITH {_LINKS} SELECT DISTINCT kind, anchor FROM (SELECT kind, anchor, person FROM k JOIN q USING (root) GROUP BY kind, anchor, person HAVING count(DISTINCT root) >= 2)",
    "g_batches": f"""WITH {_LINKS}, r AS (SELECT kind, anchor, root, min(opened) AS opened FROM k WHERE opened IS NOT NULL GROUP BY kind, anchor, root),
      w AS (SELECT *, count(*) OVER (PARTITION BY kind, anchor ORDER BY opened RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n FROM r),
      b AS (SELECT kind, anchor, max(n) AS n, arg_max(opened, (n, -epoch(opened))) AS fim FROM w GROUP BY kind, anchor HAVING max(n) >= 3),
      i AS (SELECT r.kind, r.anchor, fim, min(opened) AS inicio, count(*) AS empresas, list_sort(list(root)) AS roots FROM r JOIN b ON r.kind = b.kind AND r.anchor = b.anchor WHERE opened BETWEEN fim - INTERVAL 30 DAY AND fim GROUP BY r.kind, r.anchor, fim)
      SELECT kind, anchor, empresas, inicio, fim FROM i QUALIFY row_number() OVER (PARTITION BY roots ORDER BY CASE kind WHEN 'telefone' THEN 0 WHEN 'email' THEN 1 ELSE 3 END, anchor) = 1""",
    "g_recycled": f"WITH {_LINKS}, r AS (SELECT anchor, root, bool_and(trim(status) IN ('04', '08')) FILTER (trim(status) <> '') AS closed, min(opened) AS d0, max(opened) AS d1 FROM k WHERE kind = 'telefone' GROUP BY anchor, root) SELECT anchor, count(*) FILTER (closed) AS encerradas, count(*) FILTER (NOT closed) AS ativas, coalesce(max(d1) FILTER (NOT closed) > min(d0) FILTER (closed), false) AS depois FROM r WHERE closed IS NOT NULL GROUP BY anchor HAVING count(*) FILTER (closed) > 0 AND count(*) FILTER (NOT closed) > 0",
    "g_wrong_state": f"WITH {_LINKS} SELECT DISTINCT anchor AS phone, org, {area_state('substr(anchor, 4, 2)')} AS uf_telefone, upper(uf) AS uf FROM k WHERE kind = 'telefone' AND {area_state('substr(anchor, 4, 2)')} <> upper(uf)",
    "g_wrong_postcode": f"WITH {E}, c AS (SELECT cnpj, uf, {sql_state('d')} AS uf_cep FROM (SELECT cnpj, uf, regexp_replace(cep, '[^0-9]', '', 'g') AS d FROM e)) SELECT * FROM c WHERE uf_cep <> uf",
    "g_region": f"""WITH {E}, p AS (SELECT DISTINCT cnpj_basico, upper(trim(nome)) || CASE WHEN regexp_full_match(trim(doc), '\\*{{3}}[0-9]{{6}}\\*{{2}}') THEN ' [' || trim(doc) || ']' ELSE '' END AS person, {mask_region('doc')} AS r FROM socio WHERE nome <> ''),
      j AS (SELECT person, list_sort(list_distinct(flatten(list(r) FILTER (r IS NOT NULL)))) AS r, list_sort(list(DISTINCT uf)) AS u FROM p JOIN (SELECT DISTINCT cnpj_basico, uf FROM e) USING (cnpj_basico) GROUP BY person)
      SELECT person, array_to_string(r, ',') AS regioes, array_to_string(u, ',') AS ufs FROM j WHERE len(r) > 0 AND len(u) > 0 AND NOT list_has_any(r, u)""",
    "g_sanctions": f"WITH RECURSIVE {E}, {_OK}, {_components_sql('a')} SELECT m AS componente, count(*) FILTER (situacao = '08') AS sancoes, count(*) FILTER (matriz = 1) AS alvos FROM g JOIN e ON v = 'cnpj:' || cnpj GROUP BY m HAVING count(*) FILTER (situacao = '08') > 0 AND count(*) FILTER (matriz = 1) > 0",
    "g_delta": f"WITH {_OK}, o AS (SELECT concat_ws('|', src, relation, dst) AS k, coalesce(max(c), 0) AS c FROM a WHERE ts < TIMESTAMP '2025-05-01' GROUP BY 1), n AS (SELECT concat_ws('|', src, relation, dst) AS k, coalesce(max(c), 0) AS c FROM a WHERE ts >= TIMESTAMP '2025-04-01' GROUP BY 1), j AS (SELECT coalesce(o.k, n.k) AS k, o.c AS de, n.c AS para FROM o FULL JOIN n ON o.k = n.k) SELECT k, CASE WHEN de IS NULL THEN 'nova' WHEN para IS NULL THEN 'perdida' ELSE 'alterada' END AS mudanca, de, para FROM j WHERE de IS NULL OR para IS NULL OR abs(para - de) >= 0.05",
}
SQL["g_claims_ranked"] = f"SELECT id, confianca, row_number() OVER (ORDER BY confianca DESC NULLS LAST, id) AS posicao FROM ({SQL['g_claims']})"
SQL["g_components_ranked"] = f"SELECT componente, tamanho, row_number() OVER (ORDER BY tamanho DESC, componente) AS posicao FROM (SELECT componente, count(*) AS tamanho FROM ({SQL['g_components']}) GROUP BY componente)"
SQL["g_clusters_ranked"] = "SELECT *, row_number() OVER (ORDER BY forca DESC, tipo, chave) AS posicao FROM (" + " UNION ALL ".join(f"SELECT tipo, chave, forca FROM ({SQL[k]})" for k in ("g_block_clusters", "g_sequential_clusters", "g_domain_clusters")) + ")"
SQL["g_findings"] = f"SELECT 'uf' AS type, min(concat_ws(' ', phone, uf_telefone, uf)) AS text FROM ({SQL['g_wrong_state']}) GROUP BY phone, left(org, 8)"
