"""Garbled text: round trips over all pairs, texts to be left alone, special cases."""

import pytest

from trama.llm import encoding

NAMES = ["PANIFICAÇÃO SÃO JOÃO LTDA", "FARMÁCIA E DROGARIA", "CLÍNICA MÉDICA", "COMÉRCIO DE MÓVEIS", "ÓTICA CENTRAL", "GRÁFICA RÁPIDA", "CONSTRUÇÕES E LOCAÇÕES", "AÇOUGUE BOM", "VEÍCULOS NOVOS", "IRMÃOS SILVA", "NAÏVE ATELIÊ", "MÜLHEN & FRÈRES", "¡OLÉ! TAPAS", "25° SUL", "Padaria Pão Açucarado", "Farmácia São José"]


@pytest.fixture(scope="module")
def fix(spark):
    df = spark.createDataFrame([(n,) for n in NAMES for _ in range(30)] + [(None,), ("",), ("ASCII",)], "t string")
    return encoding.Repairer(encoding.model([df], [["t"]]))


@pytest.mark.parametrize("read_in", ["latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251"])
def test_utf8_read_in_another_encoding_comes_back(fix, read_in):
    for name in ("FARMÁCIA E DROGARIA", "CONSTRUÇÕES E LOCAÇÕES", "Farmácia São José", "CLÍNICA MÉDICA"):
        bad = encoding._read(name.encode("utf-8"), read_in)
        if bad is not None:
            assert fix.garbled(bad) and fix(bad) == name


def test_twice_and_changed_case(fix):
    once = encoding._read("AÇOUGUE BOM".encode(), "cp1252")
    assert fix(encoding._read(once.encode(), "cp1252")) == "AÇOUGUE BOM"
    assert fix(encoding._read("GRÁFICA".encode(), "latin-1").lower()) == "gráfica"


@pytest.mark.parametrize("pair", [("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")])
def test_one_byte_pairs(fix, pair):
    for name in ("FARMÁCIA", "AÇOUGUE", "VEÍCULOS"):
        bad = name.encode(pair[0]).decode(pair[1])
        assert fix(bad) == name and fix.garbled(bad)


@pytest.mark.parametrize("text", [*NAMES, "", "PLAIN", "QUER PÃO?", "LÃ ® BEBÊ", "Γ GAMA", "A£B"])
def test_right_text_is_left_alone(fix, text):
    assert fix(text) == text and not fix.garbled(text)


def test_mixed_text_only_garbled_span_changes(fix):
    assert fix("FARMÃ\x81CIA E FARMÁCIA") == "FARMÁCIA E FARMÁCIA"


def test_frame_nulls_long_repeated_clashing(spark, fix):
    rows = [("1", None, "x"), ("2", "", "x"), ("3", "SERVI�OS", "x"), ("4", "FARMÃ\x81CIA " * 20_000, "x"), ("5", "FARMÃ\x81CIA", "x"), ("5", "FARMÃ\x81CIA", "x"), ("6", "FARMÁCIA", "x")]
    df = spark.createDataFrame(rows, "id string, t string, restaurado string")
    got = encoding.find(df, fix.three, ["id"], "t").collect()
    assert sorted((r["id"], r["restavel"]) for r in got) == [("3", False), ("4", True), ("5", True), ("5", True)]
    assert encoding.find(df.limit(0), fix.three, ["id"], "t").count() == 0


def test_one_byte_pairs_restore_every_letter(spark):
    """Also a letter that no Portuguese word has, if it is the only damaged one."""
    readings = encoding.one_sign_readings()
    for c in "ÈÏÑØÄÖ":
        bad = c.encode("cp1252").decode("cp850")
        assert bad in encoding.RESTORED or ("cp1252>cp850", c) in readings[bad]
    df = spark.createDataFrame([(n,) for n in ("Ø GRAUS", "ØSTER", "FRÈRES", "PEÑA", "LAÏS") for _ in range(30)], "t string")
    fix = encoding.Repairer(encoding.model([df], [["t"]]))
    for name in ("ØSTER", "FRÈRES"):
        assert fix(name) == name and fix(name.encode("cp1252").decode("cp850")) == name


def test_a_word_with_many_dropped_seconds(spark):
    df = spark.createDataFrame([("ÁGÁTÁCÁBÁRÁ",)] * 30, "t string")
    fix = encoding.Repairer(encoding.model([df], [["t"]]))
    assert fix("ÃGÃTÃCÃBÃRÃ") == "ÁGÁTÁCÁBÁRÁ"
    assert len(fix("ÃB" * 20_000)) == 40_000  # in time that grows with the length alone
