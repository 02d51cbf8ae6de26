"""Column functions against known values."""

import pytest
from pyspark.sql import functions as F

from trama.functions import identifiers as ids
from trama.functions import phones, scoring, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


S = lambda v: F.lit(v).cast("string")


@pytest.mark.parametrize("raw", ["+5531988887777", "(31) 9 8888-7777", "31988887777", "031988887777", "5531988887777", "0 21 31 98888 7777"])
def test_phone_spellings_of_one_number(spark, raw):
    t = one(spark, phones.normalise(S(raw)))
    assert (t["valido"], t["e164"], t["tipo"], t["uf"], t["faixa"]) == (True, "+5531988887777", "movel", "MG", "3198888")


@pytest.mark.parametrize("raw,kind,ok", [("190", "especial", True), ("0800 123 4567", "nao-geografico", True), ("31 3333-4444", "fixo", True), ("20 98888-7777", "indefinido", False), ("abc", "indefinido", False), (None, "indefinido", False), ("98888-7777", "indefinido", False)])
def test_phone_kinds(spark, raw, kind, ok):
    t = one(spark, phones.normalise(S(raw)))
    assert (t["tipo"], t["valido"]) == (kind, ok)


def test_phone_default_area_and_spellings(spark):
    t = one(spark, phones.normalise(S("98888-7777"), "31"))
    assert t["e164"] == "+5531988887777"
    v = one(spark, phones.spellings(S("31"), S("988887777")))
    assert v[0] == "+5531988887777" and "(31) 8888-7777" in v and len(v) == len(set(v)) <= 24
    assert one(spark, phones.formatted(S("31"), S("988887777"))) == "(31) 9 8888-7777"


def test_identifiers(spark):
    assert one(spark, ids.cpf_valid(S("529.982.247-25"))) and not one(spark, ids.cpf_valid(S("529.982.247-26"))) and not one(spark, ids.cpf_valid(S("11111111111"))) and not one(spark, ids.cpf_valid(S(None)))
    assert one(spark, ids.cpf_mask(S("52998224725"))) == "***.982.247-**"
    assert one(spark, ids.cpf_region(S("***456789**"))) == ["PR", "SC"]
    assert one(spark, ids.cnpj_valid(S("11.222.333/0001-81"))) and one(spark, ids.cnpj_valid(S("12.ABC.345/01DE-35"))) and not one(spark, ids.cnpj_valid(S("44555666000109")))
    assert one(spark, ids.postcode_state(S("30120-010"))) == "MG" and one(spark, ids.postcode_state(S("123"))) is None
    assert one(spark, ids.plate_equivalents(S("abc-1234"))) == ["ABC1234", "ABC1C34"] and one(spark, ids.plate_equivalents(S("ABC1C34"))) == ["ABC1C34", "ABC1234"]
    assert one(spark, ids.payment_key_kind(S("+5531988887777"))) == "telefone" and one(spark, ids.payment_key_kind(S("a@b.com"))) == "email" and one(spark, ids.payment_key_kind(S("529.982.247-25"))) == "cpf" and one(spark, ids.payment_key_kind(S("x"))) is None
    with pytest.raises(ValueError):
        ids.analyse("nada", F.lit(""))


def test_slip(spark):
    line = ids.slip_line(F.lit("001"), F.lit(9000), F.lit(12345), F.lit("1" * 25))
    f = one(spark, ids.slip_fields(line))
    assert one(spark, ids.slip_valid(line)) and float(f["valor"]) == 123.45 and str(f["vencimentos"][0]) == "2022-05-29" and len(f["vencimentos"]) == 2


def test_find_documents_blanks_slips_first(spark):
    t = "CPF 529.982.247-25, de novo 52998224725, CNPJ 11.222.333/0001-81, mascara ***.982.247-**, CEP: 30120010, placa ABC1D23"
    got = {(r["tipo"], r["valor"], r["ambiguo"]) for r in one(spark, ids.find_documents(S(t)))}
    assert got == {("cpf", "52998224725", False), ("cpf", "52998224725", True), ("cnpj", "11222333000181", False), ("cpf-parcial", "***982247**", False), ("cep", "30120010", False), ("placa", "ABC1D23", False)}


def test_scores(spark):
    for g, w in (("B2", 0.64), ("a1", 0.9025), ("zz", 0.25), (None, 0.25), ("A", 0.25)):
        assert one(spark, scoring.grade_score(S(g))) == w
    assert one(spark, scoring.phone_grade(F.lit(1), S("02"))) == "A2" and one(spark, scoring.phone_grade(F.lit(12), S("8"))) == "A5" and one(spark, scoring.phone_grade(F.lit(2), S(None))) == "A3"
    df = spark.createDataFrame([("e", "x", 0.5), ("e", "x", 0.4), ("e", "y", 0.5), ("f", "x", 2.0), ("g", "x", None)], "id string, s string, c double")
    got = {r["id"]: (r["confianca"], r["fontes"], r["corroboracoes"]) for r in scoring.noisy_or(df, ["id"], "s", "c").collect()}
    assert got == {"e": (0.75, 2, 3), "f": (0.99, 1, 1), "g": (0.0, 1, 1)}


@pytest.mark.parametrize("v,want", [("20230301", "2023-03-01"), ("1/3/2023", "2023-03-01"), ("2023-03-01", "2023-03-01"), ("20230230", None), ("", None), (None, None)])
def test_dates(spark, v, want):
    d = one(spark, text.flexible_date(S(v)))
    assert (str(d) if d else None) == want


def test_page_and_shingles(spark):
    assert one(spark, text.page_text(S("<Style>x</style><P>Olá 123  Mundo</P>"))) == "olá 0 mundo"
    assert one(spark, text.shingles(S("a b c d"))) == ["a b c", "b c d"] and one(spark, text.shingles(S("a b"))) == ["a b"] and one(spark, text.shingles(S(""))) == []
    assert one(spark, text.verdict(F.lit(200), F.lit(0.95), F.lit(200), F.lit(True)))["descartar"] and not one(spark, text.verdict(F.lit(200), F.lit(0.0), F.lit(404), F.lit(True)))["descartar"]
    assert text.column_name("Nº do Certificado ") == "no_do_certificado"


def test_target_kind(spark):
    for v, k in (("A@B.com", "email"), ("11.222.333/0001-81", "cnpj"), ("30120-010", "cep"), ("https://www.x.com.br/a", "dominio"), ("31 98888-7777", "telefone")):
        assert one(spark, text.target_kind(S(v)))["tipo"] == k
