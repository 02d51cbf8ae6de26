"""Answers of web sources that were landed as a table (source, url, status, body, ts), taken apart to rows.

The engine itself fetches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trama.functions.constants import SEARCH_NOISE


def body(df: DataFrame, source: str) -> DataFrame:
    ok = df.filter((F.col("source") == source) & F.col("status").between(200, 299))
    return ok.withColumn("json", F.decode(F.col("body"), "UTF-8"))


def company(df: DataFrame) -> DataFrame:
    """(url, razao_social, uf, cep, email, telefones, socio, doc, qualificacao), one row a partner (or one without)."""
    s = "razao_social string, uf string, cep string, ddd_telefone_1 string, ddd_telefone_2 string, email string, qsa array<struct<nome_socio:string,cnpj_cpf_do_socio:string,qualificacao_socio:string>>"
    j = body(df, "cnpj-api").select("url", F.from_json("json", s).alias("j"))
    out = j.select("url", "j.razao_social", "j.uf", "j.cep", F.lower(F.trim("j.email")).alias("email"), F.array_compact(F.array("j.ddd_telefone_1", "j.ddd_telefone_2")).alias("telefones"), F.explode_outer("j.qsa").alias("q"))
    return out.select("url", "razao_social", "uf", "cep", "email", "telefones", F.col("q.nome_socio").alias("socio"), F.col("q.cnpj_cpf_do_socio").alias("doc"), F.col("q.qualificacao_socio").alias("qualificacao"))


def postcode(df: DataFrame) -> DataFrame:
    s = "cep string, logradouro string, bairro string, localidade string, uf string, ibge string, ddd string"
    return body(df, "viacep").select("url", F.from_json("json", s).alias("j")).select("url", "j.*")


def gazettes(df: DataFrame) -> DataFrame:
    """(url, territorio, uf, data, edicao, extra, documento, trecho): one row a gazette, its excerpts joined."""
    s = "gazettes array<struct<territory_name:string,state_code:string,date:string,edition:string,is_extra_edition:boolean,url:string,excerpts:array<string>>>"
    g = body(df, "querido-diario").select("url", F.explode(F.from_json("json", s)["gazettes"]).alias("g"))
    return g.select("url", F.col("g.territory_name").alias("territorio"), F.col("g.state_code").alias("uf"), F.to_date("g.date").alias("data"), F.col("g.edition").alias("edicao"), F.col("g.is_extra_edition").alias("extra"), F.col("g.url").alias("documento"), F.array_join("g.excerpts", " … ").alias("trecho"))


def registrations(df: DataFrame) -> DataFrame:
    """(url, papel, campo, valor): contact fields (fn, email, tel) of the entities of a domain registration."""
    s = "entities array<struct<handle:string,roles:array<string>,vcardArray:string>>"
    e = body(df, "rdap").select("url", F.explode(F.from_json("json", s)["entities"]).alias("e"))
    fields = F.from_json(F.get_json_object("e.vcardArray", "$[1]"), "array<array<string>>")
    return e.select("url", F.explode_outer("e.roles").alias("papel"), F.explode(fields).alias("f")).filter(F.element_at("f", 1).isin("fn", "email", "tel")).select("url", "papel", F.element_at("f", 1).alias("campo"), F.element_at("f", 4).alias("valor"))


def certificate_names(df: DataFrame, domain: Column | str) -> DataFrame:
    """(nome, n, desde): names of a domain and below it on certificates, with their number and first day."""
    s = "array<struct<name_value:string,issuer_name:string,not_before:string>>"
    d = F.lit(domain) if isinstance(domain, str) else domain
    r = body(df, "crtsh").select(F.explode(F.from_json("json", s)).alias("r")).select(F.explode(F.split(F.lower("r.name_value"), "\n")).alias("n"), "r.not_before")
    name = F.regexp_replace(F.trim("n"), r"^\*\.", "")
    ok = r.select(name.alias("nome"), "not_before").filter(~F.col("nome").contains("@") & F.col("nome").rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$") & ((F.col("nome") == d) | F.col("nome").endswith(F.concat(F.lit("."), d))))
    return ok.groupBy("nome").agg(F.count(F.lit(1)).alias("n"), F.min("not_before").alias("desde"))


def breaches(df: DataFrame) -> DataFrame:
    s = "array<struct<Name:string,Title:string,BreachDate:string,PwnCount:bigint,IsVerified:boolean,DataClasses:array<string>>>"
    b = body(df, "hibp").select("url", F.explode(F.from_json("json", s)).alias("b"))
    return b.select("url", F.col("b.Name").alias("incidente"), F.to_date("b.BreachDate").alias("data"), F.col("b.PwnCount").alias("contas"), F.array_contains("b.DataClasses", "Phone numbers").alias("telefones"))


def sanctions(df: DataFrame) -> DataFrame:
    """(url, cadastro, chave, tipo, orgao, inicio, processo) of two sanction registers."""
    s = "array<struct<id:string,tipoSancao:struct<descricaoResumida:string>,orgaoSancionador:struct<nome:string>,dataInicioSancao:string,numeroProcesso:string>>"
    rows = df.filter(F.col("source").isin("ceis", "cnep") & (F.col("status") == 200)).select("source", "url", F.explode(F.from_json(F.decode("body", "UTF-8"), s)).alias("s"))
    return rows.select("url", F.col("source").alias("cadastro"), F.concat_ws(":", "source", F.coalesce("s.id", F.concat_ws("-", "url", "s.dataInicioSancao"))).alias("chave"), F.col("s.tipoSancao.descricaoResumida").alias("tipo"), F.col("s.orgaoSancionador.nome").alias("orgao"), F.col("s.dataInicioSancao").alias("inicio"), F.col("s.numeroProcesso").alias("processo"))


def archived(df: DataFrame) -> DataFrame:
    j = body(df, "wayback")
    g = lambda p: F.get_json_object("json", f"$.archived_snapshots.closest.{p}")
    ts = g("timestamp")
    return j.filter(g("available") == "true").select("url", g("url").alias("copia"), F.concat_ws("-", F.substring(ts, 1, 4), F.substring(ts, 5, 2), F.substring(ts, 7, 2)).alias("data"))


def result_links(df: DataFrame, source: str = "web") -> DataFrame:
    """(url, link): links of result pages, redirects decoded, hosts of the engines left out, each once a page."""
    page = body(df, source)
    link = page.select("url", F.explode(F.regexp_extract_all("json", F.lit('href="([^"]+)"'), F.lit(1))).alias("l"))
    hidden = F.regexp_extract("l", r"[?&]uddg=([^&]+)", 1)
    clear = link.withColumn("link", F.when(hidden != "", F.expr("try_url_decode(regexp_extract(l, '[?&]uddg=([^&]+)', 1))")).otherwise(F.col("l")))
    noise = "|".join(n.replace(".", r"\.") for n in SEARCH_NOISE)
    return clear.filter(F.col("link").rlike("^https?://") & ~F.col("link").rlike(noise)).select("url", "link").distinct()


def contract(df: DataFrame, source: str, path: str, equals: str | None = None, contains: str | None = None) -> DataFrame:
    """(url, ok): whether an answer still has the agreed field; null where the source failed for the moment."""
    rows = df.filter(F.col("source") == source).withColumn("v", F.get_json_object(F.decode("body", "UTF-8"), path))
    want = F.col("v").isNotNull() if equals is None and contains is None else F.col("v") == equals if equals is not None else F.lower("v").contains(contains.lower())
    return rows.select("url", F.when((F.col("status") == 0) | (F.col("status") >= 500), F.lit(None).cast("boolean")).otherwise(F.coalesce(want, F.lit(False))).alias("ok"))
