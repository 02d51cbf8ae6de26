"""Raw delimited records: the valid ones as typed rows, the others with the reason.

A record is split once into its cells; the cells that a rule speaks of are
exploded into (row, column, value), meet the rule table, and the failed rules
are gathered by row. Clean rows are what remains after an anti-join with the
rows at fault. Everything is built from JVM expressions; the patterns use
possessive repetition, so a record of any length takes linear time and no
recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One cell: quoted with doubled inner quotes, or without any quote.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^";]*+)'
_RECORD = rf"^{_CELL}(?:;{_CELL})*+$"
_CELLS = rf";({_CELL})"

#: Fixed values of the format.
STATES = "AL AM BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RS SC SE SP TO".split()
STATUS = "01 02 03 04 08".split()


@dataclass(frozen=True)
class Layout:
    """width: fields of a record. rules: (column number, rule name). types: (column number, output name, cast)."""

    table: str
    width: int
    rules: tuple[tuple[int, str], ...]
    names: dict[int, tuple[str, str]] = field(default_factory=dict)


def real_date(v: Column) -> Column:
    """A date that exists, as AAAAMMDD or DD/MM/AAAA."""
    a = v.rlike(r"^[0-9]{8}$") & F.try_to_date(v, "yyyyMMdd").isNotNull()
    b = v.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & F.try_to_date(v, "dd/MM/yyyy").isNotNull()
    return F.coalesce(a | b, F.lit(False))


def read_date(v: Column) -> Column:
    return F.coalesce(F.when(v.rlike(r"^[0-9]{8}$"), F.try_to_date(v, "yyyyMMdd")), F.when(v.rlike("/"), F.try_to_date(v, "dd/MM/yyyy")))


def _clean_text(v: Column) -> Column:
    return ~v.rlike(r"[\x00-\x09\x0B-\x1F\x7F-\x9F�]")


#: What each rule asks of a value. A rule table row names one of these for a column.
RULES = {
    "raiz": lambda v: v.rlike(r"^[0-9A-Z]{8}$") & (F.length(v) == 8),
    "situacao": lambda v: v.isin(STATUS),
    "data": lambda v: (v == "") | real_date(v),
    "texto": _clean_text,
    "nome": lambda v: _clean_text(v) & ~v.rlike(r"^[\s\p{Z}]*+$"),
    "cep": lambda v: (v == "") | (v.rlike(r"^[0-9]{8}$") & (F.length(v) == 8)),
    "uf": lambda v: v.isin(STATES),
    "mascara": lambda v: (v == "") | (v.rlike(r"^\*{3}[0-9]{6}\*{2}$") & (F.length(v) == 11)),
}

ESTABLISHMENT = Layout(
    "estabelecimentos0",
    30,
    ((0, "raiz"), (4, "texto"), (5, "situacao"), (10, "data"), (18, "cep"), (19, "uf")),
    {0: ("raiz", "string"), 1: ("ordem", "string"), 2: ("dv", "string"), 3: ("matriz", "matriz"), 4: ("nome_fantasia", "string"), 5: ("situacao", "string"), 10: ("inicio", "date"), 11: ("cnae", "string"), 13: ("tipo_logradouro", "string"), 14: ("logradouro", "string"), 15: ("numero", "string"), 16: ("complemento", "string"), 17: ("bairro", "string"), 18: ("cep", "string"), 19: ("uf", "string"), 20: ("municipio", "string"), 21: ("ddd_1", "string"), 22: ("telefone_1", "string"), 27: ("email", "string")},
)
PARTNER = Layout(
    "socios0",
    11,
    ((0, "raiz"), (2, "nome"), (3, "mascara"), (5, "data")),
    {0: ("raiz", "string"), 1: ("tipo", "string"), 2: ("nome", "string"), 3: ("doc", "string"), 4: ("qualificacao", "string"), 5: ("entrada", "date"), 8: ("representante", "string")},
)


def parse(raw: DataFrame, id_col: str = "linha_id", line_col: str = "linha") -> DataFrame:
    """(linha_id, aspas, cells, n): whether the quoting holds, the cells unquoted, their number.

    One trailing carriage return belongs to the line end. A null line counts as
    an empty record, which has one field. cells is null where the quoting is broken.
    """
    line = F.regexp_replace(F.coalesce(F.col(line_col), F.lit("")), r"\r\z", "")
    ok = line.rlike(_RECORD.replace("$", r"\z"))
    cells = F.regexp_extract_all(F.concat(F.lit(";"), line), F.lit(_CELLS), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return raw.select(F.col(id_col).alias("linha_id"), ok.alias("quoted"), F.when(ok, plain).alias("cells")).withColumn("n", F.size("cells"))


#: Columns that stand for a record as a whole; they come before the others, as the first reason holds.
BROKEN, MISCOUNTED = -2, -1


def _cells(parsed: DataFrame, layout: Layout) -> DataFrame:
    """(linha_id, coluna, valor): the cells of complete records that a rule speaks of, one row each; of a record with
    broken quoting or another number of cells one row, with the column BROKEN or MISCOUNTED."""
    wanted = [F.struct(F.lit(i).alias("coluna"), F.element_at("cells", i + 1).alias("valor")) for i, _ in layout.rules]
    whole = lambda k: F.array(F.struct(F.lit(k).alias("coluna"), F.lit("").alias("valor")))
    cells = F.when(~F.col("quoted"), whole(BROKEN)).when(F.col("n") != layout.width, whole(MISCOUNTED)).otherwise(F.array(*wanted))
    return parsed.select("linha_id", F.explode(cells).alias("c")).select("linha_id", "c.*")


def rule_table(spark, layout: Layout) -> DataFrame:
    """(coluna, regra): the rules of cells, and those of whole records, which nothing passes."""
    return spark.createDataFrame([(BROKEN, "aspas"), (MISCOUNTED, "colunas"), *layout.rules], "coluna int, regra string")


def _errors(parsed: DataFrame, layout: Layout) -> DataFrame:
    # the rule table is a constant of a few rows
    j = _cells(parsed, layout).join(F.broadcast(rule_table(parsed.sparkSession, layout)), "coluna")
    broken = F.col("coluna") < 0
    for name in sorted({r for _, r in layout.rules}):
        test = (F.col("regra") == name) & ~F.coalesce(RULES[name](F.col("valor")), F.lit(False))
        broken = broken | test
    return j.filter(broken).select("linha_id", "coluna", "regra", "valor")


def cell_errors(parsed: DataFrame, layout: Layout) -> DataFrame:
    """(linha_id, coluna, regra, valor): every value that breaks its rule."""
    return _errors(parsed, layout).filter("coluna >= 0")


def faults(raw: DataFrame, layout: Layout) -> DataFrame:
    """(tabela, linha_id, motivo, erros): one row for each record at fault.

    motivo is the first that holds of aspas, colunas, valor; erros lists the
    broken rules as "cN:rule" in order of column (empty for the first two).
    """
    found = F.array_sort(F.collect_set(F.struct("coluna", "regra")))
    by = _errors(parse(raw), layout).groupBy("linha_id").agg(found.alias("e"))
    whole = F.element_at("e", 1)["coluna"] < 0
    said = F.transform("e", lambda s: F.concat(F.lit("c"), s["coluna"].cast("string"), F.lit(":"), s["regra"]))
    return by.select(
        F.lit(layout.table).alias("tabela"),
        "linha_id",
        F.when(whole, F.element_at("e", 1)["regra"]).otherwise("valor").alias("motivo"),
        F.when(whole, F.array().cast("array<string>")).otherwise(said).alias("erros"),
    )


def valid_rows(raw: DataFrame, layout: Layout) -> DataFrame:
    """The valid records as typed rows: linha_id and the named fields, empty strings as null."""
    parsed = parse(raw)
    bad = faults(raw, layout).select("linha_id")
    good = parsed.join(bad, "linha_id", "left_anti")
    out = [F.col("linha_id")]
    for i, (name, kind) in sorted(layout.names.items()):
        v = F.element_at("cells", i + 1)
        v = F.when(v != "", v)
        out.append((read_date(v) if kind == "date" else (v == "1") if kind == "matriz" else v).alias(name))
    return good.select(*out)
