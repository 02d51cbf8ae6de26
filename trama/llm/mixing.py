"""Documents of several sources in target shares of all tokens.

Hierarchical budgeting: each mixture is a tree of domains, languages and
sources whose weights are the sums of their sources' weights. The total budget
goes down the tree by weight; a node can take no more than its documents give at
the allowed number of repetitions, and what a child cannot take is shared out
among its siblings first, only then among its parent's siblings. Each source
then takes whole epochs and, of one more epoch in seeded order, the prefix of
documents that comes nearest to its budget.

The prefix needs running sums over a source, one of which may hold a third of
all rows: documents are put into buckets by their seeded position, buckets are
summed first, and running sums are made inside buckets only.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trama.llm.bpe import token_counts
from trama.llm.language import label_language
from trama.session import Work

#: Rows of a bucket, about.
BUCKET_ROWS = 4096

def leaf_table(mix: DataFrame, sizes: DataFrame, domains: DataFrame) -> list[dict]:
    """The leaves of all mixtures with their sources' tokens, on the driver: one row of the mixture table each.

    The mixture table and domains (source, dominio) are configuration (a few rows). Rows with a null or non-positive
    weight or without a repetition allowed take nothing. A row given twice counts once (the greatest weight and
    repetitions hold). A source that domains doesn't name is in the domain ""; one without documents stays in its
    domain, under the language "", and has nothing to give.
    """
    where = domains.filter("source is not null").groupBy("source").agg(F.min("dominio").alias("dominio"))
    m = mix.filter("mistura is not null and source is not null").groupBy("mistura", "source").agg(F.max("peso").alias("peso"), F.max("max_repeticoes").alias("reps"))
    rows = m.join(sizes, "source", "left").join(where, "source", "left").collect()
    return [
        {"mistura": r["mistura"], "source": r["source"], "dominio": r["dominio"] or "", "idioma": r["idioma"] or "", "peso": max(0.0, r["peso"] or 0.0), "reps": max(0, r["reps"] or 0), "tokens": r["tokens"] or 0, "docs": r["docs"] or 0}
        for r in sorted(rows, key=lambda r: (r["mistura"], r["source"]))
    ]


def _share_out(total: float, nodes: list[tuple[float, float]]) -> list[float]:
    """total shared by weight among (weight, capacity), the shortage of full ones going to the others."""
    got = [0.0] * len(nodes)
    open_ = [i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0]
    left = min(total, sum(nodes[i][1] for i in open_))
    while open_ and left > 1e-9:
        whole = sum(nodes[i][0] for i in open_)
        full = [i for i in open_ if left * nodes[i][0] / whole >= nodes[i][1]]
        if not full:
            for i in open_:
                got[i] = left * nodes[i][0] / whole
            break
        for i in full:
            got[i] = nodes[i][1]
            left -= nodes[i][1]
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(leaves: list[dict], total: float | None = None, levels: tuple[str, ...] = ("dominio", "idioma", "source")) -> list[dict]:
    """The leaves of one mixture with budget, their part of total in tokens.

    total None means all the tokens that the sources hold, each counted once. What a source cannot give at its
    repetitions goes to the other sources of its language and domain, then of its domain, then to all.
    """

    def go(rows: list[dict], amount: float, depth: int) -> None:
        if depth == len(levels):
            for r in rows:
                r["budget"] = amount
            return
        children: dict[str, list[dict]] = defaultdict(list)
        for r in rows:
            children[r[levels[depth]]].append(r)
        groups = list(children.values())
        parts = _share_out(amount, [(sum(r["peso"] for r in g), sum(r["tokens"] * r["reps"] for r in g if r["peso"] > 0)) for g in groups])
        for g, part in zip(groups, parts):
            go(g, part, depth + 1)

    leaves = [dict(r, budget=0.0) for r in leaves]
    if total is None:
        total = float(sum(r["tokens"] for r in leaves if r["peso"] > 0))
    go(leaves, total, 0)
    return leaves


def exact_total(leaves: list[dict]) -> float:
    """The most tokens at which every source that has any gets exactly its share by budgets(), without a shortage but
    of those that have none."""
    open_ = [dict(r, reps=10**12 if r["tokens"] * r["reps"] > 0 else 0) for r in leaves]
    shares = budgets(open_, 1e6)
    return min((r["tokens"] * r["reps"] * 1e6 / s["budget"] for r, s in zip(leaves, shares) if s["budget"] > 0), default=0.0) * (1 - 1e-12)


def source_sizes(docs: DataFrame, size: str = "tokens") -> DataFrame:
    """(source, idioma, tokens, docs): a source's tokens, documents with tokens, and the language that labels of most of
    its tokens name ("" if none does)."""
    by = docs.filter((F.col(size) > 0) & F.col("source").isNotNull()).groupBy("source", F.coalesce(label_language(F.col("lang")), F.lit("")).alias("idioma")).agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("source").agg(F.max_by("idioma", F.struct(F.col("idioma") != "", F.col("t"), F.col("idioma"))).alias("idioma"), F.sum("t").alias("tokens"), F.sum("n").alias("docs"))


def planned(leaves: list[dict], total: float | str | None = None) -> list[dict]:
    """The leaves of all mixtures with their budgets; total as in select()."""
    out: list[dict] = []
    for name in sorted({r["mistura"] for r in leaves}):
        own = [r for r in leaves if r["mistura"] == name]
        out += budgets(own, exact_total(own) if total == "exact" else total)
    return out


def select(documents: DataFrame, mix: DataFrame, domains: DataFrame, total: float | str | None = None, seed: int = 20240607, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of every mixture.

    uses: (mistura, source, doc_id, tokens, vezes), a row for each document used,
    vezes times, at most max_repeticoes. shares: (mistura, source, peso_alvo,
    tokens_disponiveis, max_repeticoes, orcamento, tokens, documentos, usos,
    parte), a row for each source named, those without documents with zeros.

    domains: (source, dominio), the upper level of the tree. total is in tokens of each mixture: None as many as its
    sources hold, with shortages shared out; a number; "exact" the most at which no share has to give way. Documents
    without tokens (null or empty texts) and without source are never used. Empty tables give no rows.
    """
    spark = documents.sparkSession
    work = Work(spark, "mixing")
    named = mix.select("source").filter("source is not null").distinct()
    counted = token_counts(documents.join(F.broadcast(named), "source", "left_semi").select("doc_id", "source", "lang", "text"), ["doc_id", "source", "lang"], path=path)
    docs = work.save(counted, "tokens")
    plan = planned(leaf_table(mix, source_sizes(docs), domains), total)
    rows = []
    for r in plan:
        full = min(r["reps"], int(r["budget"] // r["tokens"])) if r["tokens"] else 0
        rest = r["budget"] - full * r["tokens"] if full < r["reps"] else 0.0
        rows.append((r["mistura"], r["source"], float(r["peso"]), int(r["tokens"]), int(r["reps"]), float(r["budget"]), full, float(rest), max(1, r["docs"] // BUCKET_ROWS)))
    leaf = spark.createDataFrame(rows, "mistura string, source string, peso double, tokens_disponiveis bigint, max_repeticoes int, orcamento double, inteiras int, resto double, baldes int")
    placed = (
        docs.filter("tokens > 0")
        .select("doc_id", "source", "tokens")
        .join(F.broadcast(leaf.filter("orcamento > 0").select("mistura", "source", "inteiras", "resto", "baldes")), "source")
        .withColumn("h", F.shiftrightunsigned(F.xxhash64("mistura", "doc_id", "inteiras", F.lit(seed)), 11))
        .withColumn("b", F.floor(F.col("h") / F.lit(float(1 << 53)) * F.col("baldes")).cast("int"))
    )
    sums = placed.groupBy("mistura", "source", "b").agg(F.sum("tokens").alias("_t"))
    base = sums.select("mistura", "source", "b", (F.sum("_t").over(Window.partitionBy("mistura", "source").orderBy("b")) - F.col("_t")).alias("_base"))
    inside = Window.partitionBy("mistura", "source", "b").orderBy("h", "doc_id")
    running = placed.join(base, ["mistura", "source", "b"]).withColumn("_before", F.sum("tokens").over(inside) - F.col("tokens") + F.col("_base"))
    more = (F.col("_before") + F.col("tokens") / 2 <= F.col("resto")).cast("int")
    uses = running.select("mistura", "source", "doc_id", "tokens", (F.col("inteiras") + more).alias("vezes")).filter("vezes > 0")
    uses = work.save(uses, "uses")
    got = uses.groupBy("mistura", "source").agg(F.sum(F.col("tokens") * F.col("vezes")).alias("tokens"), F.count(F.lit(1)).alias("documentos"), F.sum("vezes").alias("usos"))
    weights = Window.partitionBy("mistura")
    shares = leaf.join(got, ["mistura", "source"], "left").select(
        "mistura",
        "source",
        (F.col("peso") / F.sum("peso").over(weights)).alias("peso_alvo"),
        "tokens_disponiveis",
        "max_repeticoes",
        "orcamento",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documentos", "usos")],
    )
    return uses, shares.withColumn("parte", F.try_divide("tokens", F.sum("tokens").over(weights)))
