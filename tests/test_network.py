"""Whole-table searches of the link graph."""

from pyspark.sql import functions as F

from trama.plans import network


def test_sampled_seeds_come_from_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    want = {f"cnpj:{r[0]}" for r in spark.read.parquet(f"{d}/estabelecimento.parquet").filter(F.col("cnpj").rlike("^[0-9]+00$")).select("cnpj").distinct().collect()}
    got = {r[0] for r in network.QUERIES["g_levels_sampled"](spark, d).filter("nivel = 0").select("id").collect()}
    assert want and got == want
