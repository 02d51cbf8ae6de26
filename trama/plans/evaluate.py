"""Queries that measure grouping heuristics, calibration, and event sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trama.functions import text
from trama.functions.constants import BENCHMARK_FREE_MAIL
from trama.operators import evaluation, graph, tables
from trama.plans.registry import E, P, latest
from trama.session import table
from trama.streaming.registry import sessions, windowed_counts


#: The providers that anyone may use: the fixed ones, and those of the test tables.
_FREE = (*BENCHMARK_FREE_MAIL, "correiolivre.test", "webcarta.test", "mailgratis.test", "caixapostal.test")


def _heuristics(spark: SparkSession, d: str) -> DataFrame:
    """(heuristica, cnpj, previsto, real): establishments by what would group them, against their company."""
    e = latest(spark, d)
    keys = {
        "email-exato": F.lower("email"),
        "dominio-email": F.when(F.col("email").contains("@"), text.mail_domain(F.col("email"), _FREE)),
        "endereco": F.concat_ws("|", "uf", "municipio", text.name_key(F.col("logradouro"))),
        "nome-fantasia": text.name_key(F.regexp_replace("nome_fantasia", "ß", "SS")),
        "telefone-compartilhado": F.col("e164_1"),
        "bloco": F.substring("e164_1", 4, 7),
    }
    parts = [e.select(F.lit(n).alias("heuristica"), "cnpj", F.when(k != "", k).alias("previsto"), F.col("cnpj_basico").alias("real")) for n, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


def v_heuristics(spark: SparkSession, d: str) -> DataFrame:
    c = evaluation.pair_counts(_heuristics(spark, d), "cnpj", "previsto", "real", ["heuristica"])
    return evaluation.precision_recall(c)


def v_best(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_configuration(v_heuristics(spark, d), "heuristica")


def v_spread(spark: SparkSession, d: str) -> DataFrame:
    """Each heuristic's mean and spread of precision and recall over the states."""
    h = _heuristics(spark, d).join(latest(spark, d).select("cnpj", "uf"), "cnpj")
    m = evaluation.precision_recall(evaluation.pair_counts(h, "cnpj", "previsto", "real", ["heuristica", "uf"]))
    return evaluation.mean_and_spread(m, ["heuristica"], ["precisao", "revocacao"]).select("heuristica", *[F.round(f"{c}_{k}", 3).alias(f"{c}_{k}") for c in ("precisao", "revocacao") for k in ("media", "desvio")])


def v_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Shared telephones with and without those of four companies or more."""
    e = latest(spark, d)
    many = tables.roots_per_phone(e).filter("raizes >= 4").select(F.col("phone").alias("e164_1"))
    kept = e.join(many, "e164_1", "left_anti")
    parts = [x.select(F.lit(n).alias("heuristica"), "cnpj", F.col("e164_1").alias("previsto"), F.col("cnpj_basico").alias("real")) for n, x in (("todos", e), ("podado", kept))]
    return evaluation.precision_recall(evaluation.pair_counts(parts[0].unionByName(parts[1]), "cnpj", "previsto", "real", ["heuristica"]))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Edges between establishments with whether both are of one company."""
    a = table(spark, d, "aresta").filter("origem like 'cnpj:%' and destino like 'cnpj:%'").filter(~F.isnan("confianca"))
    return a.select("confianca", (F.substring("origem", 6, 8) == F.substring("destino", 6, 8)).alias("certo")).filter("confianca is not null")


def v_reliability(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.reliability(_labelled(spark, d), "confianca", "certo")


def v_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration_error(v_reliability(spark, d))


def v_isotonic(spark: SparkSession, d: str) -> DataFrame:
    steps = evaluation.isotonic(_labelled(spark, d), "confianca", "certo")
    return spark.createDataFrame(steps, "limite double, valor double")


def v_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """The confidences that occur with what the fit makes of them."""
    rows = _labelled(spark, d)
    steps = evaluation.isotonic(rows, "confianca", "certo")
    return rows.select("confianca").distinct().select("confianca", evaluation.apply_steps_column(F.col("confianca"), steps).alias("calibrada"))


def v_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return graph.content_hash(table(spark, d, "aresta").select("origem", "relacao", "destino"), "origem", "relacao", "destino")


def s_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with pauses below thirty minutes."""
    return sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")


def s_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "2 hours")


def s_sliding(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "2 hours", "2 hours", "1 hour")


def v_worlds(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of the heuristics over ten synthetic worlds of fifteen groups with traps; reads no table."""
    from trama.operators import prediction
    from trama.session import Work, ship
    from trama.sources import synthetic

    ship(spark)
    registry, truth = synthetic.tables(spark, [synthetic.world(seed, 15) for seed in range(10)])
    edges = Work(spark, "worlds").save(prediction.run(registry, truth), "edges")
    return evaluation.mean_and_spread(prediction.evaluate(edges, truth), ["heuristica"], ["precisao", "revocacao", "f1"])


QUERIES = {f.__name__: f for f in (v_heuristics, v_best, v_spread, v_pruned, v_reliability, v_calibration_error, v_isotonic, v_calibrated, v_content_hash, v_worlds, s_sessions, s_windows, s_sliding)}

_OPEN = "(" + ", ".join(f"'{x}'" for x in _FREE) + ")"
_KEYS = f"""h AS (SELECT 'email-exato' AS heuristica, cnpj, uf, lower(email) AS previsto, cnpj_basico AS r FROM e
  UNION ALL SELECT 'dominio-email', cnpj, uf, CASE WHEN email LIKE '%@%' AND lower(string_split(email, '@')[-1]) NOT IN {_OPEN} THEN lower(string_split(email, '@')[-1]) END, cnpj_basico FROM e
  UNION ALL SELECT 'endereco', cnpj, uf, concat_ws('|', uf, municipio, regexp_replace(upper(replace(logradouro, 'ß', 'SS')), '[^A-Z0-9]', '', 'g')), cnpj_basico FROM e
  UNION ALL SELECT 'nome-fantasia', cnpj, uf, regexp_replace(upper(replace(nome_fantasia, 'ß', 'SS')), '[^A-Z0-9]', '', 'g'), cnpj_basico FROM e
  UNION ALL SELECT 'telefone-compartilhado', cnpj, uf, e164_1, cnpj_basico FROM e
  UNION ALL SELECT 'bloco', cnpj, uf, substr(e164_1, 4, 7), cnpj_basico FROM e), i AS (SELECT heuristica, cnpj, uf, nullif(previsto, '') AS previsto, r FROM h)"""


def _metrics(by: str, source: str = "i") -> str:
    return f"""c AS (SELECT {by}, previsto, r, count(*) AS n FROM {source} GROUP BY ALL),
    t AS (SELECT {by}, sum(n * (n - 1) / 2) AS vp FROM c WHERE previsto IS NOT NULL GROUP BY {by}),
    p AS (SELECT {by}, sum(n * (n - 1) / 2) AS pp FROM (SELECT {by}, previsto, sum(n) AS n FROM c WHERE previsto IS NOT NULL GROUP BY {by}, previsto) GROUP BY {by}),
    a AS (SELECT {by}, sum(n * (n - 1) / 2) AS ap FROM (SELECT {by}, r, sum(n) AS n FROM c GROUP BY {by}, r) GROUP BY {by}),
    x AS (SELECT {by}, coalesce(vp, 0)::BIGINT AS vp, (coalesce(pp, 0) - coalesce(vp, 0))::BIGINT AS fp, (coalesce(ap, 0) - coalesce(vp, 0))::BIGINT AS fn, coalesce(pp, 0)::BIGINT AS pares_previstos FROM a LEFT JOIN p USING ({by}) LEFT JOIN t USING ({by})),
    y AS (SELECT *, CASE WHEN vp + fp = 0 THEN 1 ELSE vp / (vp + fp) END AS pr, CASE WHEN vp + fn = 0 THEN 1 ELSE vp / (vp + fn) END AS re FROM x),
    z AS (SELECT {by}, vp, fp, fn, pares_previstos, round(pr, 4) AS precisao, round(re, 4) AS revocacao, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4) AS f1 FROM y)"""


_LABELLED = "l AS (SELECT confianca AS c, substr(origem, 6, 8) = substr(destino, 6, 8) AS k FROM aresta WHERE origem LIKE 'cnpj:%' AND destino LIKE 'cnpj:%' AND NOT isnan(confianca) AND confianca IS NOT NULL)"
_BINS = "CASE " + " ".join(f"WHEN c >= {a} AND c {'<=' if b == 1.0 else '<'} {b} THEN '{a:.1f}-{b:.1f}'" for a, b in zip(evaluation.BINS, evaluation.BINS[1:])) + " END"
_RELIABLE = f"{_LABELLED}, b AS (SELECT {_BINS} AS faixa, count(*) AS n, round(avg(c), 4) AS confianca_media, round(avg(k::INTEGER), 4) AS precisao_observada FROM l GROUP BY 1)"
_SESSION = "w AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER q + INTERVAL 30 MINUTE OR lag(ts) OVER q IS NULL THEN 1 ELSE 0 END AS novo FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(novo) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM w)"

SQL = {
    "v_heuristics": f"WITH {E}, {_KEYS}, {_metrics('heuristica')} SELECT * FROM z",
    "v_best": f"WITH {E}, {_KEYS}, {_metrics('heuristica')} SELECT heuristica, f1, precisao FROM z ORDER BY f1 DESC, precisao DESC, heuristica LIMIT 1",
    "v_spread": f"WITH {E}, {_KEYS}, {_metrics('heuristica, uf')} SELECT heuristica, round(round(avg(precisao), 4), 3) AS precisao_media, round(round(stddev_pop(precisao), 4), 3) AS precisao_desvio, round(round(avg(revocacao), 4), 3) AS revocacao_media, round(round(stddev_pop(revocacao), 4), 3) AS revocacao_desvio FROM z GROUP BY heuristica",
    "v_pruned": f"WITH {P}, m AS (SELECT phone FROM p GROUP BY phone HAVING count(DISTINCT cnpj_basico) >= 4), i2 AS (SELECT 'todos' AS heuristica, cnpj, e164_1 AS previsto, cnpj_basico AS r FROM e UNION ALL SELECT 'podado', cnpj, e164_1, cnpj_basico FROM e WHERE e164_1 IS NULL OR e164_1 NOT IN (SELECT phone FROM m)), {_metrics('heuristica', 'i2').replace('p AS (', 'pz AS (', 1).replace('LEFT JOIN p USING', 'LEFT JOIN pz USING')} SELECT * FROM z",
    "v_reliability": f"WITH {_RELIABLE} SELECT * FROM b WHERE faixa IS NOT NULL",
    "v_calibration_error": f"WITH {_RELIABLE} SELECT round(coalesce(sum(n * abs(confianca_media - precisao_observada)) / sum(n), 0), 4) AS ece FROM b WHERE faixa IS NOT NULL",
    # the fit at x is the greatest, over starts up to x, of the least mean of the runs from there to x or beyond
    "v_calibrated": f"""WITH {_LABELLED}, g AS (SELECT round(c, 4) AS x, sum(k::INTEGER)::DOUBLE AS s, count(*) AS n FROM l GROUP BY 1),
      r AS (SELECT a.x AS i, b.x AS j, (SELECT sum(s) / sum(n) FROM g WHERE g.x BETWEEN a.x AND b.x) AS m FROM g a JOIN g b ON b.x >= a.x),
      f AS (SELECT x, max(low) AS v FROM (SELECT g.x, r.i, min(r.m) AS low FROM g JOIN r ON r.i <= g.x AND r.j >= g.x GROUP BY g.x, r.i) GROUP BY x)
      SELECT DISTINCT c AS confianca, round(v, 4) AS calibrada FROM l JOIN f ON f.x = round(c, 4)""",
    "s_sessions": f"WITH {_SESSION} SELECT user_id, min(ts) AS inicio, max(ts) + INTERVAL 30 MINUTE AS fim, count(*) AS n FROM s GROUP BY user_id, k",
    "s_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS inicio, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS fim, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "s_sliding": "WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type FROM events), w AS (SELECT h AS inicio, event_type FROM b UNION ALL SELECT h - INTERVAL 1 HOUR, event_type FROM b) SELECT inicio, inicio + INTERVAL 2 HOUR AS fim, event_type, count(*) AS n FROM w GROUP BY inicio, event_type",
}
