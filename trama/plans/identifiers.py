"""Queries of the identifier, telephone, date and text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.functions import identifiers as ids
from trama.functions.constants import SPELLINGS
from trama.functions import phones, scoring, text
from trama.plans import sqltext as q
from trama.session import table


def f_cnpj(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cnpj")
    return table(spark, d, "estabelecimento").select("cnpj").distinct().select("cnpj", ids.cnpj_valid(c).alias("valido"), ids.cnpj_root(c).alias("raiz"), ids.cnpj_headquarters(c).alias("matriz"), ids.cnpj_has_letters(c).alias("alfanumerico"), ids.cnpj_format(c).alias("formatado"))


def _made(spark: SparkSession, d: str, size: int) -> DataFrame:
    """Digits made from every order key: one number an order, of which some are valid by chance or by a check digit."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lpad(((k * 7919 + 104729) % F.lit(10**9)).cast("string"), 9, "0").alias("b"), F.lpad(k.cast("string"), size, "0").alias("n"))


_MADE = "(SELECT o_orderkey, lpad(((o_orderkey * 7919 + 104729) % 1000000000)::VARCHAR, 9, '0') AS b, lpad(o_orderkey::VARCHAR, {size}, '0') AS n FROM orders)"


def f_cpf(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat("b", ids.cpf_check(F.col("b")))
    m = _made(spark, d, 11).withColumn("cpf", full)
    c = F.col("cpf")
    return m.select("o_orderkey", "cpf", ids.cpf_valid(c).alias("valido"), ids.cpf_valid(F.col("n")).alias("chave_valida"), ids.cpf_format(c).alias("formatado"), ids.cpf_mask(c).alias("mascara"), F.array_join(ids.cpf_region(c), ",").alias("regiao"))


def f_mask_region(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "socio")
    return s.select("doc").distinct().select("doc", F.array_join(ids.cpf_region(F.col("doc")), ",").alias("regiao"))


def f_numbers(spark: SparkSession, d: str) -> DataFrame:
    n11, n12, n15 = F.col("n"), F.concat(F.substring("b", 1, 8), F.lpad((F.col("o_orderkey") % 29).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")), F.concat(F.element_at(F.array(*map(F.lit, "12789")), (F.col("o_orderkey") % 5 + 1).cast("int")), F.col("b"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))
    return _made(spark, d, 11).select("o_orderkey", ids.pis_valid(n11).alias("pis"), ids.renavam_valid(n11).alias("renavam"), ids.licence_valid(n11).alias("cnh"), ids.voter_valid(n12).alias("titulo"), ids.voter_state(n12).alias("titulo_uf"), ids.health_card_valid(n15).alias("cns"))


def f_plate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.concat(F.lit("ab"), F.char((k % 26 + 65).cast("int")), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    m = F.concat(F.substring(p, 1, 5), F.char((k % 26 + 65).cast("int")), F.substring(p, 7, 2))
    x = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(p, m)).alias("placa"))
    return x.select("o_orderkey", "placa", ids.plate_kind(F.col("placa")).alias("tipo"), F.array_join(ids.plate_equivalents(F.col("placa")), ",").alias("equivalentes"))


def f_slip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = _made(spark, d, 25).withColumn("linha", ids.slip_line(F.lit("001"), k % 10000, k * 100 + 7, F.col("n")))
    wrong = F.concat(F.substring("linha", 1, 46), ((F.substring("linha", 47, 1).cast("int") + 1) % 10).cast("string"))
    m = m.withColumn("f", ids.slip_fields(F.col("linha")))
    f = F.col("f")
    return m.select("o_orderkey", "linha", ids.slip_valid(F.col("linha")).alias("valida"), ids.slip_valid(wrong).alias("errada"), f["valor"].cast("double").alias("valor"), f["fator"].alias("fator"), F.array_join(F.transform(f["vencimentos"], lambda x: x.cast("string")), ",").alias("vencimentos"))


def f_payment_key(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "chave").select(F.col("valor"))
    b = table(spark, d, "estabelecimento").select(F.col("cnpj").alias("valor"))
    v = a.unionByName(b).filter("valor is not null").distinct()
    return v.select("valor", ids.payment_key_kind(F.col("valor")).alias("tipo"))


def f_postcode(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "estabelecimento").select("cep").distinct()
    c = F.col("cep")
    return v.select("cep", ids.postcode_valid(c).alias("valido"), ids.postcode_state(c).alias("uf"), ids.postcode_format(c).alias("formatado"))


PHONE = ("valido", "e164", "ddd", "assinante", "tipo", "uf", "faixa", "csp", "chave")


def f_phone(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chave").filter("tipo = 'telefone'").select("valor").distinct().withColumn("t", phones.normalise(F.col("valor")))
    t = F.col("t")
    return v.select("valor", *[t[n].alias(n) for n in PHONE])


def f_spellings(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "estabelecimento").select("e164_1").filter("e164_1 is not null").distinct()
    v = v.withColumn("t", phones.normalise(F.col("e164_1")))
    t = F.col("t")
    return v.select("e164_1", phones.formatted(t["ddd"], t["assinante"]).alias("formatado"), F.explode(phones.spellings(t["ddd"], t["assinante"])).alias("grafia"))


def f_find_phones(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(phones.find(F.col("text"))).alias("t"))
    return t.select("doc_id", F.col("t.chave").alias("chave"), F.col("t.tipo").alias("tipo")).distinct()


def f_find_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(ids.find_documents(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", F.col("t.tipo").alias("tipo"), F.col("t.valor").alias("valor")).agg(F.min_by("t.ambiguo", "t.ordem").alias("ambiguo"))


def f_find_mails(spark: SparkSession, d: str) -> DataFrame:
    m = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.explode(m).alias("email")).distinct()


def f_dates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "estabelecimento").select(F.col("inicio").alias("v"))
    b = table(spark, d, "socio").select(F.col("entrada").alias("v"))
    return a.unionByName(b).distinct().select("v", text.flexible_date(F.col("v")).alias("data"), text.long_date(text.flexible_date(F.col("v"))).alias("extenso"))


def f_grade(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = F.concat(F.substring(F.lit("ABCDEFXa"), (k % 8 + 1).cast("int"), F.lit(1)), F.substring(F.lit("1234567"), (F.floor(k / 8) % 7 + 1).cast("int"), F.lit(1)))
    s = scoring.grade_score(F.col("grau"))
    return table(spark, d, "orders").select(g.alias("grau")).distinct().select("grau", s.alias("peso"), scoring.level(s).alias("nivel"))


def f_person_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "socio").select("nome", "doc").distinct().select("nome", "doc", text.person_key(F.col("nome"), F.col("doc")).alias("pessoa"))


def f_target_kind(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chave").select("valor").unionByName(table(spark, d, "estabelecimento").select(F.col("cnpj").alias("valor"))).filter("valor is not null").distinct()
    v = v.withColumn("t", text.target_kind(F.col("valor")))
    t = F.col("t")
    return v.select("valor", t["tipo"].alias("tipo"), t["valor"].alias("canonico"))


def f_page(spark: SparkSession, d: str) -> DataFrame:
    p = text.page_text(F.concat(F.lit("<style>a{}</style><p>"), "text", F.lit("</p><script>x=1</script>")))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(p).alias("sinais"), F.sha2(p, 256).alias("sha"))


def f_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the next one: shingle likeness and the verdict it would give for a page."""
    p = table(spark, d, "documents").filter("text is not null").select("doc_id", text.page_text(F.col("text")).alias("p"))
    w = p.select("doc_id", text.shingles(F.col("p")).alias("s"))
    n = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    j = w.join(n, "doc_id").select("doc_id", F.round(text.jaccard(F.col("s"), F.col("t")), 6).alias("semelhanca"))
    v = text.verdict(F.lit(200), F.col("semelhanca"), F.lit(200), F.lit(True))
    return j.select("doc_id", "semelhanca", v["descartar"].alias("descartar"))


QUERIES = {f.__name__: f for f in (f_cnpj, f_cpf, f_mask_region, f_numbers, f_plate, f_slip, f_payment_key, f_postcode, f_phone, f_spellings, f_find_phones, f_find_documents, f_find_mails, f_dates, f_grade, f_person_key, f_target_kind, f_page, f_similarity)}

_PAGE = "trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')), '[0-9]+', '0', 'g'), '\\s+', ' ', 'g'))"
_SHINGLES = "CASE WHEN p = '' THEN [] WHEN len(w) < 3 THEN [p] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END"
_N12 = "(substr(b, 1, 8) || lpad((o_orderkey % 29)::VARCHAR, 2, '0') || lpad((o_orderkey % 100)::VARCHAR, 2, '0'))"
_N15 = "(substr('12789', (o_orderkey % 5 + 1)::INTEGER, 1) || b || lpad((o_orderkey % 100000)::VARCHAR, 5, '0'))"
_MONTHS = "['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro']"
_VOTER = "(CASE substr(t, 9, 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in q.VOTER_STATE.items()) + " END)"

#: The fixed spellings as SQL: {x} becomes a column.
_SPELT = ", ".join("'" + x.replace("{", "' || ").replace("}", " || '") + "'" for x in SPELLINGS)

SQL = {
    "f_cnpj": f"SELECT cnpj, coalesce({q.cnpj_valid('s')}, false) AS valido, left(s, 8) AS raiz, substr(s, 9, 4) = '0001' AS matriz, regexp_matches(s, '[A-Z]') AS alfanumerico, CASE WHEN length(s) = 14 THEN substr(s,1,2) || '.' || substr(s,3,3) || '.' || substr(s,6,3) || '/' || substr(s,9,4) || '-' || substr(s,13,2) ELSE cnpj END AS formatado FROM (SELECT DISTINCT cnpj, {q.cnpj_clean('cnpj')} AS s FROM estabelecimento)",
    "f_cpf": f"SELECT o_orderkey, c AS cpf, {q.cpf_valid('c')} AS valido, {q.cpf_valid('n')} AS chave_valida, substr(c,1,3) || '.' || substr(c,4,3) || '.' || substr(c,7,3) || '-' || substr(c,10,2) AS formatado, '***.' || substr(c,4,3) || '.' || substr(c,7,3) || '-**' AS mascara, array_to_string({q.region('substr(c, 9, 1)')}, ',') AS regiao FROM (SELECT o_orderkey, n, b || {q.cpf_check('b')} AS c FROM {_MADE.format(size=11)})",
    "f_mask_region": f"SELECT DISTINCT doc, array_to_string({q.mask_region('doc')}, ',') AS regiao FROM socio",
    "f_numbers": f"SELECT o_orderkey, {q.pis_valid('n')} AS pis, {q.renavam_valid('n')} AS renavam, {q.licence_valid('n')} AS cnh, {q.voter_valid('t')} AS titulo, {_VOTER} AS titulo_uf, {q.health_valid('h')} AS cns FROM (SELECT *, {_N12} AS t, {_N15} AS h FROM {_MADE.format(size=11)})",
    "f_plate": f"""WITH o AS (SELECT o_orderkey, 'ab' || chr((o_orderkey % 26 + 65)::INTEGER) || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS a FROM orders),
      p AS (SELECT o_orderkey, a AS placa FROM o UNION ALL SELECT o_orderkey, substr(a, 1, 5) || chr((o_orderkey % 26 + 65)::INTEGER) || substr(a, 7, 2) FROM o),
      c AS (SELECT *, upper(regexp_replace(placa, '[^A-Za-z0-9]', '', 'g')) AS s FROM p), k AS (SELECT *, {q.plate_kind('s')} AS tipo, substr(s, 5, 1) AS f FROM c)
      SELECT o_orderkey, placa, tipo, CASE WHEN tipo = 'antiga' THEN s || ',' || left(s, 4) || translate(f, '0123456789', 'ABCDEFGHIJ') || substr(s, 6) WHEN tipo = 'mercosul' AND f BETWEEN 'A' AND 'J' THEN s || ',' || left(s, 4) || translate(f, 'ABCDEFGHIJ', '0123456789') || substr(s, 6) WHEN tipo = 'mercosul' THEN s ELSE '' END AS equivalentes FROM k""",
    "f_slip": f"""WITH m AS (SELECT o_orderkey, '0019' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || lpad((o_orderkey * 100 + 7)::VARCHAR, 10, '0') || n AS o FROM {_MADE.format(size=25)}),
      r AS (SELECT o_orderkey, o, (11 - {q.weighted('o', [2 + (42 - i) % 8 for i in range(43)])} % 11) AS r FROM m),
      b AS (SELECT o_orderkey, substr(o, 1, 4) || (CASE WHEN r IN (0, 10, 11) THEN 1 ELSE r END)::VARCHAR || substr(o, 5) AS b FROM r),
      p AS (SELECT o_orderkey, b, substr(b, 1, 4) || substr(b, 20, 5) AS x, substr(b, 25, 10) AS y, substr(b, 35, 10) AS z FROM b),
      l AS (SELECT o_orderkey, b, x || {q.mod10('x', 1, 9)}::VARCHAR || y || {q.mod10('y', 1, 10)}::VARCHAR || z || {q.mod10('z', 1, 10)}::VARCHAR || substr(b, 5, 15) AS linha, substr(b, 6, 4)::INTEGER AS fator FROM p)
      SELECT o_orderkey, linha, {q.slip_valid('linha')} AS valida, {q.slip_valid("(substr(linha, 1, 46) || ((substr(linha, 47, 1)::INTEGER + 1) % 10)::VARCHAR)")} AS errada,
        substr(b, 10, 10)::BIGINT / 100 AS valor, fator, concat_ws(',', CASE WHEN fator > 0 THEN (DATE '1997-10-07' + fator)::VARCHAR END, CASE WHEN fator >= 1000 THEN (DATE '2025-02-22' + (fator - 1000))::VARCHAR END) AS vencimentos FROM l""",
    "f_payment_key": f"SELECT valor, {q.payment_kind('trim(valor)')} AS tipo FROM (SELECT valor FROM chave UNION SELECT cnpj FROM estabelecimento) WHERE valor IS NOT NULL",
    "f_postcode": f"SELECT cep, {q.postcode_state('d')} IS NOT NULL AS valido, {q.postcode_state('d')} AS uf, CASE WHEN length(d) = 8 THEN left(d, 5) || '-' || substr(d, 6) ELSE cep END AS formatado FROM (SELECT DISTINCT cep, {q.digits('cep')} AS d FROM estabelecimento)",
    "f_spellings": f"""WITH v AS (SELECT DISTINCT e164_1 FROM estabelecimento WHERE e164_1 IS NOT NULL), t AS (SELECT e164_1, substr(e164_1, 4, 2) AS ddd, substr(e164_1, 6) AS s FROM v
        WHERE regexp_full_match(e164_1, '\\+55[0-9]{{10,11}}') AND {q.area_state('substr(e164_1, 4, 2)')} IS NOT NULL),
      b AS (SELECT *, s AS c FROM t UNION ALL SELECT *, CASE WHEN length(s) = 9 THEN substr(s, 2) ELSE '9' || s END FROM t WHERE (length(s) = 9 AND s[1] = '9') OR (length(s) = 8 AND s[1] IN ('6', '7', '8', '9'))),
      h AS (SELECT *, substr(c, 1, CASE WHEN length(c) = 9 THEN 5 ELSE 4 END) AS p1, substr(c, CASE WHEN length(c) = 9 THEN 6 ELSE 5 END) AS p2 FROM b),
      g AS (SELECT e164_1, ddd, s, k0 + CASE WHEN c = s THEN 0 ELSE 100 END AS k, grafia FROM (SELECT *, unnest([{_SPELT}]) AS grafia, unnest(range({len(SPELLINGS)})) AS k0 FROM h)),
      r AS (SELECT e164_1, ddd, s, grafia, row_number() OVER (PARTITION BY e164_1 ORDER BY min(k)) AS n FROM g GROUP BY e164_1, ddd, s, grafia)
      SELECT e164_1, CASE WHEN length(s) = 9 THEN '(' || ddd || ') ' || s[1] || ' ' || substr(s, 2, 4) || '-' || substr(s, 6) ELSE '(' || ddd || ') ' || substr(s, 1, 4) || '-' || substr(s, 5) END AS formatado, grafia FROM r WHERE n <= 24""",
    "f_phone": q.phone_rows("(SELECT DISTINCT valor FROM chave WHERE tipo = 'telefone')", "trim(valor)", "valor"),
    "f_find_phones": f"""SELECT DISTINCT doc_id, chave, tipo FROM ({q.phone_rows("(SELECT doc_id, unnest(regexp_extract_all(text, '" + phones.PHONE_PATTERN + "')) AS m FROM documents)", 'm', 'doc_id')}) WHERE valido""",
    "f_find_mails": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+')) AS email FROM documents",
    "f_dates": f"SELECT v, d AS data, day(d)::VARCHAR || ' de ' || {_MONTHS}[month(d)] || ' de ' || year(d)::VARCHAR AS extenso FROM (SELECT v, {q.flexible_date('v')} AS d FROM (SELECT inicio AS v FROM estabelecimento UNION SELECT entrada FROM socio))",
    "f_grade": """WITH g AS (SELECT DISTINCT substr('ABCDEFXa', (o_orderkey % 8 + 1)::INTEGER, 1) || substr('1234567', ((o_orderkey // 8) % 7 + 1)::INTEGER, 1) AS grau FROM orders),
      s AS (SELECT grau, round(CASE upper(left(grau, 1)) WHEN 'A' THEN 0.95 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.6 WHEN 'D' THEN 0.4 WHEN 'E' THEN 0.2 ELSE 0.5 END::DOUBLE * CASE substr(grau, 2, 1) WHEN '1' THEN 0.95 WHEN '2' THEN 0.8 WHEN '3' THEN 0.6 WHEN '4' THEN 0.4 WHEN '5' THEN 0.2 ELSE 0.5 END::DOUBLE, 4) AS peso FROM g)
      SELECT grau, peso, CASE WHEN peso >= 0.75 THEN 'alta' WHEN peso >= 0.5 THEN 'media' WHEN peso >= 0.25 THEN 'baixa' ELSE 'indiciaria' END AS nivel FROM s""",
    "f_person_key": "SELECT DISTINCT nome, doc, upper(trim(coalesce(nome, ''))) || CASE WHEN regexp_full_match(trim(doc), '\\*{3}[0-9]{6}\\*{2}') THEN ' [' || trim(doc) || ']' ELSE '' END AS pessoa FROM socio",
    "f_page": f"SELECT doc_id, length(p) AS sinais, sha256(p) AS sha FROM (SELECT doc_id, {_PAGE.format(x='text')} AS p FROM documents WHERE text IS NOT NULL)",
    "f_similarity": f"""WITH p AS (SELECT doc_id, {_PAGE.format(x='text')} AS p FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, p, string_split(p, ' ') AS w FROM p), s AS (SELECT doc_id, {_SHINGLES} AS s FROM w)
      SELECT a.doc_id, j AS semelhanca, j >= 0.9 AS descartar FROM (SELECT x.doc_id, round(CASE WHEN len(x.s) = 0 AND len(y.s) = 0 THEN 1 WHEN len(x.s) = 0 OR len(y.s) = 0 THEN 0 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) END, 6) AS j FROM s x JOIN s y ON y.doc_id = x.doc_id + 1) a""",
}
