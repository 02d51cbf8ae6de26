"""Registry files, recipes, landed answers, sinks and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from trama.sources import landed, recipes, registry, sinks
from trama.streaming import registry as streams

LINE = '"11222333";"0001";"81";"1";"AURORA";"02";"0";"0";"";"";"10/01/2015";"6201501";"";"RUA";"DOS ANDRADAS";"1500";"";"CENTRO";"30120010";"MG";"BELO HORIZONTE";"31";"33334444";"31";"988887777";"";"";"Contato@Aurora.com";"";""'


def test_registry_csv_and_zip(spark, tmp_path):
    (tmp_path / "Estabelecimentos0.csv").write_bytes((LINE + "\n" + '"x";"y"\n').encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("Estabelecimentos0.csv", (LINE + "\n" + '"x";"y"\n').encode("latin-1"))
    for raw in (registry.read_csv(spark, str(tmp_path / "Estabelecimentos0.csv"), "estabelecimento"), registry.read_zip(spark, str(tmp_path / "e.zip"), "estabelecimento")):
        r = registry.establishments(raw, ["mg"], small=True).collect()
        assert [(x["cnpj"], x["e164_1"], x["e164_2"], x["email"], x["logradouro"]) for x in r] == [("11222333000181", "+553133334444", "+5531988887777", "contato@aurora.com", "RUA DOS ANDRADAS, 1500")]
    assert registry.file_kind("K3241.ESTABELE") == "estabelecimento" and registry.file_kind("x") is None


def test_recipes(spark, tmp_path):
    (tmp_path / "cnes.csv").write_text("CO_CNES;NO_FANTASIA;NU_TELEFONE;NO_EMAIL;NU_CNPJ\n1;CLINICA X;(31) 3333-4444;A@B.com;11222333000181\n")
    rows = recipes.read(spark, str(tmp_path / "cnes.csv"))
    rec, look = recipes.records(rows, recipes.RECIPES["cnes"], "cnes")
    assert rec.first()["rotulo"] == "CLINICA X" and {(r["tipo"], r["valor"]) for r in look.collect()} == {("telefone", "+553133334444"), ("email", "a@b.com"), ("cnpj", "11222333000181")}
    (tmp_path / "f.csv").write_text("CN,PREFIXO,FAIXA_INICIAL,FAIXA_FINAL,PRESTADORA\n31,98888,0000,9999,OP\n")
    r = recipes.ranges(recipes.read(spark, str(tmp_path / "f.csv"))).first()
    assert (r["inicio"], r["fim"]) == (988880000, 988889999)
    (tmp_path / "own").mkdir()
    (tmp_path / "own/a.json").write_text(json.dumps({"id": "minha", "colunas": {"rotulo": ["x"]}}))
    (tmp_path / "own/b.json").write_text("{")
    assert "minha" in recipes.load(str(tmp_path / "own"))
    g = recipes.read(spark, str(tmp_path / "cnes.csv")).withColumnRenamed("nu_telefone", "telefone_1")
    assert recipes.resolve(g.columns, None)["telefone"] == "telefone_1"


def test_landed(spark):
    rows = [
        ("crtsh", "u", 200, json.dumps([{"name_value": "*.x.com\na.x.com\nb@x.com\nz.org", "issuer_name": "i", "not_before": "2020-01-02"}, {"name_value": "a.x.com", "issuer_name": "i", "not_before": "2019-01-01"}]).encode()),
        ("cnpj-api", "u", 200, json.dumps({"razao_social": "R", "qsa": [{"nome_socio": "S"}]}).encode()),
        ("viacep", "u", 200, json.dumps({"cep": "1", "ibge": "9"}).encode()),
        ("rdap", "u", 200, json.dumps({"entities": [{"roles": ["registrant"], "vcardArray": ["vcard", [["fn", {}, "text", "NOME"], ["org", {}, "text", "X"]]]}]}).encode()),
        ("web", "u", 200, b'<a href="/l/?uddg=https%3A%2F%2Fa.com%2Fx">k</a><a href="https://www.google.com/x">'),
        ("viacep", "v", 503, b""),
    ]
    df = spark.createDataFrame(rows, "source string, url string, status int, body binary")
    assert {(r["nome"], r["n"], r["desde"]) for r in landed.certificate_names(df, "x.com").collect()} == {("x.com", 1, "2020-01-02"), ("a.x.com", 2, "2019-01-01")}
    assert landed.company(df).first()["socio"] == "S" and landed.postcode(df).first()["ibge"] == "9"
    assert [(r["papel"], r["campo"], r["valor"]) for r in landed.registrations(df).collect()] == [("registrant", "fn", "NOME")]
    assert [r["link"] for r in landed.result_links(df).collect()] == ["https://a.com/x"]
    assert {(r["url"], r["ok"]) for r in landed.contract(df, "viacep", "$.ibge", equals="9").collect()} == {("u", True), ("v", None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x|<y>")], "k string, v string")
    assert "x\\|" in sinks.report_markdown("T", [("H", df, 5)]) and "&lt;y&gt;" in sinks.report_html("T", [("H", df, 5)])
    sinks.write_registry_csv(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '"a";"x|<y>"'
    assert json.loads(sinks.graph_json(df, df))["entidades"] == [{"k": "a", "v": "x|<y>"}]


def test_stream_upsert_and_distinct(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "2025-01-01 00:00:00"), ("a", 2, "2025-01-01 00:01:00"), ("b", 1, "2025-01-01 00:00:00")], "k string, o int, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    s = streams.arriving(spark, src, "k string, o int, ts timestamp")
    streams.upsert(s, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "o").start().awaitTermination()
    assert {(r["k"], r["o"]) for r in spark.read.parquet(str(tmp_path / "t/v0")).collect()} == {("a", 2), ("b", 1)}
    q = streams.distinct_within(s, ["k"], "ts", "10 minutes").writeStream.format("memory").queryName("d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("d").count() == 2


def test_index_export_and_import(spark, tmp_path):
    import pytest

    from trama.sources import index, synthetic

    reg, _ = synthetic.tables(spark, [synthetic.world(1, 5)])
    tables = {"estabelecimento": reg.establishments, "empresa": reg.companies, "socio": reg.partners}
    state = reg.establishments.first()["uf"]
    m = index.export(spark, tables, str(tmp_path / "x"), state)
    got = index.load(spark, str(tmp_path / "x"))
    assert got["estabelecimento"].count() == m["tabelas"]["estabelecimento"]["linhas"] == reg.establishments.filter(f"uf = '{state}'").count()
    assert got["empresa"].select("cnpj_basico").subtract(got["estabelecimento"].select("cnpj_basico")).count() == 0
    piece = next((tmp_path / "x/socio").glob("*.parquet"))
    piece.write_bytes(piece.read_bytes() + b"x")
    (tmp_path / "x/socio" / f".{piece.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "x"))


def test_drawing(spark):
    from trama.sources import drawing

    e = spark.createDataFrame([("a<b", "c"), ("c", "d")], "src string, dst string")
    assert drawing.page(e, "T").count("<circle") == 3 and "a&lt;b" in drawing.page(e, "T")
    assert drawing.page(e.limit(0), "T").count("<circle") == 0
