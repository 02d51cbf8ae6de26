"""Hot keys, records that fail to parse, snapshot changes: special cases on small fixtures."""

from collections import Counter

import pytest

from trama.operators import hot_join, parse_faults, skew, snapshot_diff

LAYOUT = parse_faults.ESTABLISHMENT


def record(**at):
    c = [""] * 30
    c[0], c[4], c[5], c[10], c[18], c[19] = "12345678", "NOME", "02", "20200229", "30120010", "MG"
    for k, v in at.items():
        c[int(k[1:])] = v
    return ";".join('"' + x.replace('"', '""') + '"' for x in c)


def reasons(spark, lines, layout=LAYOUT):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "linha_id long, linha string, tabela string")
    return {r["linha_id"]: r["motivo"] for r in parse_faults.faults(df, layout).collect()}


def test_parse_reasons(spark):
    good = [record(), record() + "\r", record(c4='COM "ASPAS"; E PONTO\nE LINHA'), record(c10="29/02/2020"), record(c10="", c18=""), ";".join(["12345678", "", "", "", "N", "03", *[""] * 13, "SP", *[""] * 10])]
    bad = {
        "aspas": ['"a;b', 'a"b;c', record()[:-1], '"a" ;b', record(c29="z") + "x"],
        "colunas": ["", None, "\r", ";" * 28, record() + ";", "a;b"],
        "valor": [record(c0="1234567"), record(c0="1234567a"), record(c5="2"), record(c10="20210229"), record(c10="2020-02-29"), record(c18="3012001"), record(c19="XX"), record(c19=""), record(c4="A\x00"), record(c4="A\r"), record(c4="�"), record(c4="A\x85")],
    }
    lines, want = list(good), {}
    for why, rows in bad.items():
        for x in rows:
            want[len(lines)] = why
            lines.append(x)
    assert reasons(spark, lines) == want


def test_parse_long_record_is_linear(spark):
    assert reasons(spark, [";" * 200_000, '"' + 'x""' * 100_000 + '"', '"' + "x" * 300_000]) == {0: "colunas", 1: "colunas", 2: "aspas"}


def test_partner_rules(spark):
    row = lambda name, mask, day: f'12AB5678;2;"{name}";{mask};05;{day};;;;;'
    lines = [row("ANA", "***123456**", "20200101"), row("  ", "", ""), row("ANA", "***12345**", ""), row("ANA", "", "32/01/2020"), row("ANA", "", "")]
    assert reasons(spark, lines, parse_faults.PARTNER) == {1: "valor", 2: "valor", 3: "valor"}


def test_valid_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, record(c4='A ""x""'.replace('""', '"'))), (2, "x")], "linha_id long, linha string")
    rows = parse_faults.valid_rows(df, LAYOUT).collect()
    assert [(r["linha_id"], r["nome_fantasia"], str(r["inicio"]), r["email"]) for r in rows] == [(1, 'A "x"', "2020-02-29", None)]
    assert parse_faults.faults(df.limit(0), LAYOUT).count() == 0


def test_faults_list_all_broken_rules(spark):
    df = spark.createDataFrame([(1, record(c0="x", c19="ZZ"))], "linha_id long, linha string")
    assert parse_faults.faults(df, LAYOUT).first()["erros"] == ["c0:raiz", "c19:uf"]


def test_salted_figures_equal_plain_counts(spark):
    rows = [("hot", f"e{i % 500}") for i in range(3000)] + [("k%d" % (i % 40), f"e{i % 7}") for i in range(800)] + [(None, "a"), ("", "b"), ("solo", None)]
    df = spark.createDataFrame([(v, e, "x") for v, e in rows], "v string, _entity string, _salt string").withColumnRenamed("_entity", "root")
    got = {r["valor"]: (r["linhas"], r["empresas"]) for r in skew.salted_aggregate(skew.long_form(df, {"t.v": "v"}, "root")).collect()}
    n, d = Counter(v for v, _ in rows), {v: len({e for w, e in rows if w == v and e is not None}) for v, _ in rows}
    assert got == {v: (n[v], d[v]) for v in n}


def test_heavy_values_threshold_ties_and_nulls(spark):
    rows = [("a",)] * 1 + [("b",)] * 2 + [(None,)] * 50 + [("",)] * 47
    df = spark.createDataFrame([(v, "r") for (v,) in rows], "v string, root string")
    heavy = skew.heavy_values([skew.long_form(df, {"t.v": "v"}, "root")]).collect()
    assert {(r["valor"], r["linhas"]) for r in heavy} == {("a", 1), ("b", 2)}  # exactly one per cent counts
    assert skew.heavy_values([skew.long_form(df.limit(0), {"t.v": "v"}, "root")]).count() == 0


SNAP = "carga int, linha long, cnpj string, nome_fantasia string, situacao string, uf string, cep string, email string, e164_1 string, h1 string"


def changes(spark, rows, meta):
    out = snapshot_diff.registry_changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame(meta, "carga int, k string, v string"))
    return {(r["mes"], r["cnpj"], r["mudanca"]) for r in out.collect()}


def meta(carga, month, built):
    return [(carga, "mes_referencia", month), (carga, "construido_em", built), (carga, "construido_em", built)]


def row(carga, linha, cnpj, nome="A", sit="02", cep="30120010", email=None, tel=None):
    return (carga, linha, cnpj, nome, sit, "MG", cep, email, tel, "x")


def test_changes(spark):
    m = meta(1, "2024-12", "2025-01-02T00:00:00Z") + meta(2, "01/2025", "2025-02-02T00:00:00Z") + meta(3, "202501", "2025-02-02T01:00:00+02:00") + meta(4, "2025-02", "2025-03-02T00:00:00Z")
    rows = [row(1, 1, "11"), row(1, 2, "22"), row(1, 3, "33", email="")]
    rows += [row(2, 1, "11.", nome=" a "), row(2, 2, "3/3", sit="2", cep="30.120-010"), row(2, 3, "44"), row(2, 9, "44", nome="B"), row(2, 5, "44", nome="C")]
    rows += [row(3, 1, "99")]  # built before delivery 2 of the same month
    rows += [row(4, 1, "11", nome="A", sit="08"), row(4, 2, "33"), row(4, 3, "44", nome="b")]
    assert changes(spark, rows, m) == {("2025-01", "22", "removed"), ("2025-01", "44", "added"), ("2025-02", "11", "changed")}


def test_changes_empty_and_single(spark):
    m = meta(1, "2024-12", "2025-01-02T00:00:00Z")
    assert changes(spark, [row(1, 1, "11"), row(1, 1, None)], m) == set()
    assert snapshot_diff.registry_changes(spark.createDataFrame([], SNAP), spark.createDataFrame([], "carga int, k string, v string")).count() == 0


@pytest.mark.parametrize("v,want", [("2025-03", "2025-03"), ("202503", "2025-03"), ("3/2025", "2025-03"), ("2025-03-31", "2025-03"), ("01/03/2025", "2025-03"), ("x", None), (None, None)])
def test_month(spark, v, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(snapshot_diff.parse_month(F.lit(v).cast("string")).alias("m")).first()["m"] == want


def test_hot_lookup_equals_join(spark):
    many = spark.createDataFrame([("hub", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i int")
    one = spark.createDataFrame([("hub", 1), ("k3", 2), ("z", 3)], "k string, v int")
    hot = hot_join.hot_keys(many, "k")
    assert hot == ["hub"]
    for how in ("inner", "left"):
        a, b = hot_join.hot_lookup(many, "k", "i", one, hot, how), many.join(one, "k", how)
        assert sorted(map(str, a.select("k", "i", "v").collect())) == sorted(map(str, b.select("k", "i", "v").collect()))
