"""Addresses: parsing, comparison, estimation, and pairs on a small town."""

import pandas as pd
import pytest

from trama.llm import addresses as A

SCHEMA = "cnpj string, uf string, municipio string, bairro string, logradouro string, cep string, words string"


@pytest.mark.parametrize("text,want", [
    ("AVENIDA DR. JOSE SILVA, 00120 SALA 3 - CENTRO", ("120", "AVENIDA", "DOUTOR JOSE SILVA")),
    ("#120 loja 2, av. doutor josé silva", ("120", "AVENIDA", "DOUTOR JOSE SILVA")),
    ("DR JOSE SILVA, AV., Nº 120", ("120", "AVENIDA", "DOUTOR JOSE SILVA")),
    ("RUA DAS FLORES S/Nº FUNDOS", ("SN", "RUA", "FLORES")),
    ("RUA DAS FLORES, SEM NUMERO", ("SN", "RUA", "FLORES")),
    ("TV. S. PEDRO NOVO, 7 12 ANDAR", ("7", "TRAVESSA", "S PEDRO NOVO")),
    ("RUA DAS FLORES", ("", "RUA", "FLORES")),
    ("", ("", "", "")),
    (None, ("", "", "")),
])
def test_parse(text, want):
    assert A.parse_street(text) == want


def test_levels():
    assert A.street_level("DOUTOR JOSE SILVA", "DOUTOR JOSE SILVA") == 3
    assert A.street_level("DOUTOR JOSE SILVA", "DOUTOR J SILVA") == 2 and A.street_level("JOSE SIVLA", "DOUTOR JOSE SILVA") == 2
    assert A.street_level("DOUTOR JOSE SILVA", "DOUTOR PEDRO SOUZA") == 0 and A.street_level("", "X") == 0
    assert A.parse_postcode("30.120-010") == "30120010" and A.parse_postcode("00000000") == "" and A.parse_postcode("3120010") == "03120010"
    assert A.parse_district("VL. NOVA") == "VILA NOVA" and A.parse_district("NAO INFORMADO") == ""


def test_estimation_separates_and_keeps_missing_level():
    rows = [(3, 1, 1, 2, 400), (2, 1, -1, 2, 300), (2, -1, 1, -1, 100), (0, 0, 0, 1, 500), (0, 1, 0, 1, 200), (1, 0, 0, 1, 90)]
    p = pd.DataFrame(rows, columns=[*A.FIELDS, "n"])
    _, _, _, post = A.estimate(p)
    assert (post[:3] > 0.9).all() and (post[3:] < 0.1).all()


def place(cnpj, street, cep="30120010", bairro="CENTRO", town="CIDADE", uf="MG"):
    return (cnpj, uf, town, bairro, street, cep, "clash")


def test_pairs(spark):
    rows = []
    streets = ["AVENIDA DOUTOR JOSE SILVA", "RUA MARIA SOUZA LIMA", "TRAVESSA PADRE ANTONIO VIEIRA", "RUA BARAO PEDRO ALMEIDA", "LARGO CORONEL BENTO GARCIA"]
    for i, s in enumerate(streets):
        for n in range(6):
            cep = f"3012{i}0{n}0"[:5] + f"{i}1{n}"
            rows += [place(f"{i}{n}a", f"{s}, {n + 10}", cep), place(f"{i}{n}b", f"{n + 10}, {s}".replace("DOUTOR", "DR").replace("RUA", "R."), cep, None)]
    rows += [place("sn1", "RUA MARIA SOUZA LIMA, S/N"), place("sn2", "R. MARIA S. LIMA SN"), place("sn3", "RUA BARAO PEDRO ALMEIDA S/N"), place("far", "AVENIDA DOUTOR JOSE SILVA, 10", town="OUTRA"), place("nonum", "AVENIDA DOUTOR JOSE SILVA"), place(None, "RUA MARIA SOUZA LIMA, 10"), place("null", None), place("notown", "RUA MARIA SOUZA LIMA, 10", town=None)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["cnpj_a"], r["cnpj_b"]) for r in A.same_place(df).collect()}
    assert got == {(f"{i}{n}a", f"{i}{n}b") for i in range(5) for n in range(6)} | {("sn1", "sn2")}
    assert A.same_place(df.limit(0)).count() == 0


def test_very_long_address(spark):
    df = spark.createDataFrame([place("1", "RUA " + "X" * 100_000 + " SILVA, 5"), place("2", "RUA " + "X" * 100_000 + " SILVA, 5")], SCHEMA)
    assert [(r["cnpj_a"], r["cnpj_b"]) for r in A.same_place(df).collect()] == [("1", "2")]
