"""Graph, cluster, table, evaluation and custody operators on small hand-built inputs."""

import random

import pytest
from pyspark.sql import functions as F

from trama.operators import analyzers, claims, clusters, custody, evaluation, graph, tables


def groups(pairs, nodes=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("s", "s")]
    df = spark.createDataFrame([*pairs, (None, "x")], "src string, dst string")
    assert {r["id"]: r["componente"] for r in graph.components(df).collect()} == groups(pairs)
    assert graph.components(df.limit(0)).count() == 0


def test_levels_and_bridges(spark):
    e = spark.createDataFrame([("a", "x", 0.9), ("x", "b", 0.5), ("x", "b", 0.7), ("b", "y", 0.3), ("q", "q", 1.0)], "src string, dst string, confidence double")
    t = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {(r["origem"], r["id"], r["nivel"]) for r in graph.levels(e, t.filter("id = 'a'"), 2).collect()} == {("a", "a", 0), ("a", "x", 1), ("a", "b", 2)}
    r = graph.bridges(e, t, 4).collect()
    assert [(x["de"], x["para"], x["saltos"], x["elo_mais_fraco"], x["caminho"]) for x in r] == [("a", "b", 2, 0.7, ["a", "x", "b"])]


def test_degree_counts_loops_twice(spark):
    e = spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r["id"]: r["grau"] for r in graph.degree(n, e).collect()} == {"a": 3, "b": 1, "c": 0}


def test_sequences_blocks_domains(spark):
    p = spark.createDataFrame([("p1", "31", "33330001", "3133330"), ("p2", "31", "33330019", "3133330"), ("p3", "31", "33330040", "3133330"), ("p4", "21", "33330041", "2133330"), ("p5", "31", "x", None)], "id string, ddd string, assinante string, faixa string")
    s = clusters.sequential(p).collect()
    assert [(r["chave"], r["membros"]) for r in s] == [("31-33330001", ["p1", "p2"])]
    assert [r["membros"] for r in clusters.by_block(p).collect()] == [["p1", "p2", "p3"]]
    m = spark.createDataFrame([("m1", "a@x.com"), ("m2", "b@X.com"), ("m3", "a@gmail.com"), ("m4", "b@gmail.com"), ("m5", "z")], "id string, value string")
    assert {(r["chave"], r["forca"]) for r in clusters.by_mail_domain(m).collect()} == {("x.com", 0.7), ("gmail.com", 0.25)}


def test_intermediaries(spark):
    links = spark.createDataFrame([("telefone", "t", f"o{i}", f"r{i}") for i in range(5)] + [("telefone", "u", f"o{i}", f"r{i}") for i in range(5, 10)], "kind string, anchor string, org string, root string")
    people = spark.createDataFrame([(f"r{i}", f"p{i}") for i in range(5)] + [(f"r{i}", "dono") for i in range(5, 10)], "root string, person string")
    assert [(r["anchor"], r["empresas"]) for r in analyzers.intermediaries(links, people).collect()] == [("t", 5)]


@pytest.mark.parametrize("days,found", [(["2023-03-01", "2023-03-05", "2023-03-09", "2023-03-13"], 1), (["2023-03-01", "2023-06-05", "2023-09-09"], 0), (["2023-03-01", "2023-03-05"], 0)])
def test_batches(spark, days, found):
    rows = [(k, "x", f"r{i}", d) for i, d in enumerate(days) for k in ("telefone", "cep")]
    links = spark.createDataFrame(rows, "kind string, anchor string, root string, opened string").withColumn("opened", F.to_date("opened"))
    got = analyzers.batches(links).collect()
    assert len(got) == found and all(r["kind"] == "telefone" for r in got)


@pytest.mark.parametrize("a,b,n", [("08", "02", 1), ("02", "02", 0), ("08", "04", 0), ("08", None, 0)])
def test_recycled_lines(spark, a, b, n):
    links = spark.createDataFrame([("t", "r1", a, "2001-01-01"), ("t", "r2", b, "2010-01-01")], "anchor string, root string, status string, opened string").withColumn("opened", F.to_date("opened"))
    r = analyzers.recycled_lines(links).collect()
    assert len(r) == n and all(x["depois"] for x in r)


def test_pair_counts_equal_listing(spark):
    rng = random.Random(1)
    items = [(f"i{k}", rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"])) for k in range(40)]
    pairs = lambda j: {(p[0], q[0]) for p in items for q in items if p[0] < q[0] and p[j] is not None and p[j] == q[j]}
    p, a = pairs(1), pairs(2)
    r = evaluation.precision_recall(evaluation.pair_counts(spark.createDataFrame(items, "i string, p string, a string"), "i", "p", "a")).first()
    assert (r["vp"], r["fp"], r["fn"]) == (len(p & a), len(p - a), len(a - p))


def test_isotonic_steps(spark):
    rows = [(0.1, False), (0.2, True), (0.3, False), (0.4, True), (0.4, True), (0.9, True)]
    steps = evaluation.isotonic(spark.createDataFrame(rows, "s double, h boolean"), "s", "h")
    values = [v for _, v in steps]
    assert values == sorted(values) and evaluation.apply_steps(0.25, steps) == 0.5 and evaluation.apply_steps(5, steps) == values[-1]
    assert evaluation.isotonic(spark.createDataFrame([], "s double, h boolean"), "s", "h") == [] and evaluation.apply_steps(0.3, []) == 0.3


def test_custody_chain(spark, tmp_path):
    log = []
    for i in range(4):
        custody.append(log, case_id="C", action="a.b", target=f"é{i}", metadata='{"x": 1}')
    df = lambda rows: spark.createDataFrame([tuple(r[k] for k in [*custody.FIELDS, "hash"]) for r in rows], custody.SCHEMA)
    assert custody.verify(df(log)).count() == 0
    changed = [dict(r) for r in log]
    changed[1]["target"] = "outro"
    assert [(r["seq"], r["falha"]) for r in custody.verify(df(changed)).collect()] == [(2, "conteudo")]
    assert {r["falha"] for r in custody.verify(df([log[0], log[2], log[3]])).collect()} == {"numero", "elo"} or custody.verify(df([log[0], log[2], log[3]])).count() >= 1
    (tmp_path / "a.txt").write_text("x")
    m = custody.manifest(spark, str(tmp_path))
    m.count()
    stated = spark.createDataFrame([tuple(r) for r in m.collect()] + [("b.txt", 1, "0")], "path string, bytes long, sha256 string")
    assert [(r["path"], r["falha"]) for r in custody.manifest_check(m, stated).collect()] == [("b.txt", "ausente")]


def test_tables(spark):
    r = spark.createDataFrame([("31", 988880000, 988889999, "A"), ("21", 1, 5, "B")], "ddd string, lo long, hi long, c string")
    p = spark.createDataFrame([("31", 988887777), ("31", 977777777), ("21", 5), (None, 3)], "ddd string, n long")
    assert {(x["n"], x["c"]) for x in tables.range_join(p, r, "ddd", "n", "lo", "hi").collect()} == {(988887777, "A"), (5, "B")}
    v = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("j", 1, "x"), ("j", 1, "x")], "k string, o int, v string")
    assert {(x["k"], x["v"]) for x in tables.keep_last(v, ["k"], ["o"]).collect()} == {("k", None), ("j", "x")}
    a = tables.seeded_sample(spark.range(100).selectExpr("string(id) as k"), "k", 10, 7).collect()
    assert a == tables.seeded_sample(spark.range(100).repartition(7).selectExpr("string(id) as k"), "k", 10, 7).collect()


def test_claims(spark):
    e = spark.createDataFrame([("e1", "a", "r", "b", 0.8), ("e2", "a", "r", "c", 0.3)], "id string, src string, relation string, dst string, confidence double")
    ev = spark.createDataFrame([("e2",)], "edge_id string")
    c = claims.derive(e)
    assert [(r["texto"], r["nivel"]) for r in c.collect()] == [("a r b", "alta")]
    assert [r["falha"] for r in claims.validate(c, e, ev).collect()] == ["aresta sem fonte"]
