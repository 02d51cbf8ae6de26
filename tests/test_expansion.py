"""Expansion, cases, synthetic worlds and predicted groups."""

import pytest

from trama import engine
from trama.operators import expansion, prediction
from trama.sources import synthetic


@pytest.fixture(scope="module")
def registry(spark):
    est = [
        ("11222333000181", "11222333", 1, "AURORA", "02", "MG", "BH", "C", "RUA A, 1", "30120010", "contato@aurora.test", "+553133334444", "+5531988887777", "20150110", "1"),
        ("11222333000262", "11222333", 0, "AURORA", "02", "MG", "BH", "C", "RUA B, 2", None, "", "+553133334444", None, "20160110", "1"),
        ("99888777000100", "99888777", 1, "ZENITE", "08", "SP", "SP", "C", "RUA C, 3", "01310100", None, "+5531988887777", None, "20100110", "1"),
    ]
    soc = [("11222333", "Ana Lima", "***123456**", "49", "20150110", None), ("11222333", "Ana Lima", "***123456**", "49", "20150110", None), ("11222333", None, None, "49", "20150110", None)]
    texts = spark.createDataFrame([("d1", "Ligar (31) 3333-4444 ou ana@aurora.test; CPF 529.982.247-25, CNPJ 11.222.333/0001-81"), ("d2", None)], "id string, text string")
    return expansion.Registry(spark.createDataFrame(est, synthetic.EST), spark.createDataFrame([("11222333", "AURORA LTDA")], "cnpj_basico string, razao_social string"), spark.createDataFrame(soc, "cnpj_basico string, nome string, doc string, qualificacao string, entrada string, representante string"), texts)


def test_one_level(spark, registry):
    t = spark.createDataFrame([("telefone:+553133334444",), (None,)], "id string")
    got = {(r["src"].split(":")[0], r["relation"], r["dst"], r["confidence"]) for r in expansion.edges(expansion.expand(t, registry, 0)).collect()}
    assert ("telefone", "telefone_declarado_por", "organizacao:11222333000181", 0.76) in got
    assert ("telefone", "pertence_ao_bloco", "faixa:3133334", 0.38) in got
    assert ("organizacao", "telefone_declarado", "telefone:+5531988887777", 0.57) in got  # two companies declare it
    assert ("pessoa", "documento_parcial", "cpf-parcial:***123456**", 0.76) in got
    assert ("organizacao", "mesmo_grupo_cadastral", "organizacao:11222333000262", 0.76) in got
    assert ("organizacao", "endereco_no_cep", "cep:30120010", 0.76) in got
    assert len({g for g in got if g[1] == "tem_socio"}) == 1


def test_levels_and_scope(spark, registry):
    t = spark.createDataFrame([("telefone:+553133334444",)], "id string")
    reach = lambda **k: {r["dst"] for r in expansion.expand(t, registry, 1, **k).filter("relation = 'telefone_declarado_por'").collect()}
    assert "organizacao:99888777000100" in reach()
    assert "organizacao:99888777000100" not in reach(scope=spark.createDataFrame([("x",)], "id string"))
    assert expansion.expand(t.limit(0), registry, 1).count() == 0


def test_texts_give_masks_only(spark, registry):
    t = spark.createDataFrame([("documento:d1",)], "id string")
    got = {r["dst"] for r in expansion.expand(t, registry, 0).collect()}
    assert got == {"telefone:+553133334444", "email:ana@aurora.test", "cpf-parcial:***982247**", "organizacao:11222333000181"}


def test_case_and_investigation(spark, registry):
    with pytest.raises(ValueError):
        engine.Case("C", "a", " ", "2999-01-01T00:00:00+00:00")
    c = engine.Case("C", "a", "base", "2999-01-01T00:00:00+00:00")
    assert c.add_target(spark, "(31) 3333-4444") == ("telefone", "+553133334444")
    with pytest.raises(engine.OutOfScope):
        c.authorise("+5531988887777")
    r = engine.investigate(spark, c, registry, 1)
    assert r.edges.count() > 5 and r.claims.filter("nivel = 'alta'").count() > 0
    assert {x["tipo"] for x in r.clusters.collect()} >= {"ancora-organizacao"}
    assert [x["action"] for x in c.log][-1] == "coleta.fim" and "escopo.recusado" in {x["action"] for x in c.log}
    old = engine.Case("C", "a", "base", "2001-01-01T00:00:00+00:00", scope=["x"])
    with pytest.raises(engine.OutOfScope):
        old.authorise("x")


def test_world_is_seeded_and_traps_are_found(spark):
    a, b = synthetic.world(3, 6), synthetic.world(3, 6)
    assert a.establishments == b.establishments and a.truth == b.truth and a.establishments != synthetic.world(4, 6).establishments
    reg, truth = synthetic.tables(spark, [a])
    edges = prediction.run(reg, truth, 1)
    from trama.session import Work

    edges = Work(spark, "t").save(edges, "edges")
    m = {r["heuristica"]: r for r in prediction.evaluate(edges, truth).collect()}
    assert m["combinado 0.2 podado"]["precisao"] >= m["combinado 0.2"]["precisao"]
    assert m["combinado 0.8"]["vp"] == 0 if "combinado 0.8" in m else True
    f = {(r["type"], r["entity_ids"][0]) for r in engine.findings(edges, reg.establishments).collect()}
    traps = dict(a.traps)
    assert ("lote-de-registro", f"telefone:{traps['fachada']}") in f and ("intermediario-provavel", f"telefone:{traps['fachada']}") in f
    assert ("linha-possivelmente-reciclada", f"telefone:{traps['linha']}") in f
