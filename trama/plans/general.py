"""Queries of the general data problems: hot keys, records that fail to parse, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.operators import parse_faults, skew, snapshot_diff
from trama.session import table


def _hot_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    est = skew.long_form(table(spark, d, "estabelecimento"), {"estabelecimento.e164_1": "e164_1", "estabelecimento.cep": "cep"}, "cnpj_basico")
    soc = skew.long_form(table(spark, d, "socio"), {"socio.nome": "nome"}, "cnpj_basico")
    return [est, soc]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_values(_hot_tables(spark, d)).select("campo", "valor")


def p5_figures(spark: SparkSession, d: str) -> DataFrame:
    a, b = _hot_tables(spark, d)
    return skew.salted_aggregate(a.unionByName(b)).filter(skew.present()).select("campo", "valor", "linhas", "empresas")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    e = parse_faults.faults(table(spark, d, "estabelecimentos0"), parse_faults.ESTABLISHMENT)
    s = parse_faults.faults(table(spark, d, "socios0"), parse_faults.PARTNER)
    return e.unionByName(s).select("tabela", "linha_id", "motivo")


def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for layout in (parse_faults.ESTABLISHMENT, parse_faults.PARTNER):
        errors = parse_faults.cell_errors(parse_faults.parse(table(spark, d, layout.table)), layout)
        out.append(errors.select(F.lit(layout.table).alias("tabela"), "linha_id", "coluna", "regra", "valor"))
    return out[0].unionByName(out[1])


def p6_establishments(spark: SparkSession, d: str) -> DataFrame:
    return parse_faults.valid_rows(table(spark, d, "estabelecimentos0"), parse_faults.ESTABLISHMENT)


def p6_partners(spark: SparkSession, d: str) -> DataFrame:
    return parse_faults.valid_rows(table(spark, d, "socios0"), parse_faults.PARTNER)


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.registry_changes(table(spark, d, "estabelecimento_snap"), table(spark, d, "meta"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_changes(spark, d).select("mes", "cnpj", "mudanca")


QUERIES = {f.__name__: f for f in (p5_found, p5_figures, p6_found, p6_errors, p6_establishments, p6_partners, p7_found, p7_changes)}

_HOT = """
WITH v AS (
  SELECT 'estabelecimento.e164_1' AS campo, e164_1 AS valor, cnpj_basico AS r FROM estabelecimento
  UNION ALL SELECT 'estabelecimento.cep', cep, cnpj_basico FROM estabelecimento
  UNION ALL SELECT 'socio.nome', nome, cnpj_basico FROM socio)
"""

_CELL = r"""(?:"(?:[^"]|"")*"|[^";]*)"""
_STATES = ", ".join(f"'{s}'" for s in parse_faults.STATES)
_STATUS = ", ".join(f"'{s}'" for s in parse_faults.STATUS)


def _date_ok(v: str) -> str:
    return f"""({v} = '' OR (regexp_full_match({v}, '[0-9]{{8}}') AND try_strptime({v}, '%Y%m%d') IS NOT NULL)
      OR (regexp_full_match({v}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AND try_strptime({v}, '%d/%m/%Y') IS NOT NULL))"""


def _text_ok(v: str) -> str:
    return f"NOT regexp_matches({v}, '[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]')"


_CHECK = {
    "raiz": lambda v: f"regexp_full_match({v}, '[0-9A-Z]{{8}}')",
    "situacao": lambda v: f"{v} IN ({_STATUS})",
    "data": _date_ok,
    "texto": _text_ok,
    "nome": lambda v: f"({_text_ok(v)} AND NOT regexp_full_match({v}, '[\\s\\p{{Z}}]*'))",
    "cep": lambda v: f"({v} = '' OR regexp_full_match({v}, '[0-9]{{8}}'))",
    "uf": lambda v: f"{v} IN ({_STATES})",
    "mascara": lambda v: f"({v} = '' OR regexp_full_match({v}, '\\*{{3}}[0-9]{{6}}\\*{{2}}'))",
}


def _parsed(layout: parse_faults.Layout) -> str:
    cells = f"regexp_extract_all(';' || l, ';({_CELL})', 1)"
    return f"""SELECT linha_id, ok, CASE WHEN ok THEN list_transform({cells},
        lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) END AS c
      FROM (SELECT linha_id, l, regexp_full_match(l, '{_CELL}(?:;{_CELL})*') AS ok
            FROM (SELECT linha_id, CASE WHEN right(coalesce(linha, ''), 1) = chr(13) THEN left(linha, length(linha) - 1) ELSE coalesce(linha, '') END AS l FROM {layout.table}))"""


def _faults_sql(layout: parse_faults.Layout) -> str:
    good = " AND ".join(_CHECK[r](f"c[{i + 1}]") for i, r in layout.rules)
    return f"""SELECT tabela, linha_id, motivo FROM (SELECT '{layout.table}' AS tabela, linha_id,
      CASE WHEN NOT ok THEN 'aspas' WHEN len(c) <> {layout.width} THEN 'colunas' WHEN NOT ({good}) THEN 'valor' END AS motivo
      FROM ({_parsed(layout)})) WHERE motivo IS NOT NULL"""


def _errors_sql(layout: parse_faults.Layout) -> str:
    return " UNION ALL ".join(f"""SELECT '{layout.table}' AS tabela, linha_id, {i}::INTEGER AS coluna, '{r}' AS regra, c[{i + 1}] AS valor
      FROM ({_parsed(layout)}) WHERE ok AND len(c) = {layout.width} AND NOT {_CHECK[r](f"c[{i + 1}]")}""" for i, r in layout.rules)


def _valid_sql(layout: parse_faults.Layout) -> str:
    cols = []
    for i, (name, kind) in sorted(layout.names.items()):
        v = f"nullif(c[{i + 1}], '')"
        v = f"coalesce(try_strptime({v}, '%Y%m%d'), try_strptime({v}, '%d/%m/%Y'))::DATE" if kind == "date" else f"{v} = '1'" if kind == "matriz" else v
        cols.append(f"{v} AS {name}")
    good = " AND ".join(_CHECK[r](f"c[{i + 1}]") for i, r in layout.rules)
    return f"SELECT linha_id, {', '.join(cols)} FROM ({_parsed(layout)}) WHERE ok AND len(c) = {layout.width} AND {good}"


def _blank(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


_CHANGES = f"""
WITH d AS (
  SELECT carga, max(CASE WHEN k = 'mes_referencia' THEN
      CASE WHEN regexp_matches(trim(v), '^\\d{{4}}\\D?(0[1-9]|1[0-2])') THEN left(trim(v), 4) || '-' || regexp_extract(trim(v), '^\\d{{4}}\\D?(0[1-9]|1[0-2])', 1)
           ELSE right(trim(v), 4) || '-' || lpad(regexp_extract(trim(v), '(\\d{{1,2}})\\D\\d{{4}}$', 1), 2, '0') END END) AS mes,
    max(CASE WHEN k = 'construido_em' THEN v::TIMESTAMPTZ END) AS t
  FROM meta GROUP BY carga),
m AS (SELECT carga, mes, row_number() OVER (ORDER BY mes) - 1 AS ordem
      FROM (SELECT mes, arg_max(carga, (t, carga)) AS carga FROM d WHERE mes IS NOT NULL AND t IS NOT NULL GROUP BY mes)),
c AS (SELECT m.ordem, m.mes, upper(regexp_replace(cnpj, '[^0-9A-Za-z]', '', 'g')) AS cnpj, linha,
        lower({_blank('nome_fantasia')}) AS nome,
        CASE WHEN length({_blank('situacao')}) = 1 THEN '0' ELSE '' END || lower({_blank('situacao')}) AS situacao,
        nullif(lower(regexp_replace(cep, '[^0-9A-Za-z]', '', 'g')), '') AS cep,
        lower({_blank('email')}) AS email, lower({_blank('e164_1')}) AS fone
      FROM estabelecimento_snap s JOIN m ON s.carga = m.carga),
h AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ordem, cnpj ORDER BY linha DESC) = 1),
j AS (SELECT coalesce(n.ordem, o.ordem + 1) AS ordem, coalesce(n.cnpj, o.cnpj) AS cnpj,
        CASE WHEN o.cnpj IS NULL THEN 'added' WHEN n.cnpj IS NULL THEN 'removed'
             WHEN (n.nome, n.situacao, n.cep, n.email, n.fone) IS DISTINCT FROM (o.nome, o.situacao, o.cep, o.email, o.fone) THEN 'changed' END AS mudanca,
        o.situacao AS de, n.situacao AS para
      FROM h n FULL JOIN h o ON n.ordem = o.ordem + 1 AND n.cnpj = o.cnpj)
SELECT m.mes, j.cnpj, j.mudanca, j.de, j.para FROM j JOIN m ON m.ordem = j.ordem WHERE j.ordem > 0 AND j.mudanca IS NOT NULL
"""

SQL = {
    "p5_found": _HOT + """SELECT campo, valor FROM (SELECT campo, valor, count(*) AS n, sum(count(*)) OVER (PARTITION BY campo) AS t FROM v GROUP BY campo, valor)
      WHERE valor <> '' AND n >= 0.01 * t""",
    "p5_figures": _HOT + "SELECT campo, valor, count(*) AS linhas, count(DISTINCT r) AS empresas FROM v WHERE valor <> '' GROUP BY campo, valor",
    "p6_found": _faults_sql(parse_faults.ESTABLISHMENT) + " UNION ALL " + _faults_sql(parse_faults.PARTNER),
    "p6_errors": _errors_sql(parse_faults.ESTABLISHMENT) + " UNION ALL " + _errors_sql(parse_faults.PARTNER),
    "p6_establishments": _valid_sql(parse_faults.ESTABLISHMENT),
    "p6_partners": _valid_sql(parse_faults.PARTNER),
    "p7_changes": _CHANGES,
    "p7_found": f"SELECT mes, cnpj, mudanca FROM ({_CHANGES})",
}
