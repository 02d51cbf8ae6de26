"""Graph tables (entity, edge, evidence, finding) and their operators.

edge has src, dst, relation and confidence; traversal is undirected. Iterative
operators write each step below the shared folder and go on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trama.operators.hot_join import hot_keys, hot_lookup
from trama.session import Work, steady


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge in both directions, as node, other and the columns named."""
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *keep)
    return one.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *keep))


def degree(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, grau): ends of edges at each entity, a self-loop counting two, 0 for none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    return entities.select("id").join(ends, "id", "left").select("id", F.coalesce("count", F.lit(0)).cast("bigint").alias("grau"))


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, componente): the least id of each component, by alternating large and small stars.

    Each step links a node's larger neighbours, then its smaller ones, to the
    least one; the number of steps grows as the logarithm of the longest path.
    Null ends are no edges; a self-loop makes a component of one. Nodes that
    hold many of the edges of a step are spread over slots, told from a sample.
    """
    spark = edges.sparkSession
    work = Work(spark, "stars")
    ok = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = work.save(ok.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "nodes")
    rows = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    current = work.save(ok.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **rows)
    own = steady(spark)
    inside = Work(own, "stars")

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        j = hot_lookup(both, "u", "v", least, hot_keys(both, "u", n))
        if large:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    figures, mark, k = current.figures, None, 0
    current = inside.load(current, own)
    while figures["mark"] != mark:
        mark = figures["mark"]
        step = inside.save(star(current, True, 2 * figures["n"]), f"large{k}", **rows)
        nxt = inside.save(star(step, False, step.figures["n"]), f"small{k}", **rows)
        inside.drop(step)
        inside.drop(current)
        current, figures, k = nxt, nxt.figures, k + 1
    found = inside.load(current, spark)
    return nodes.join(found.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("componente"))


def filtered_components(entities: DataFrame, edges: DataFrame, edge_ok: Column, node_ok: Column) -> DataFrame:
    """Components over the edges that pass edge_ok and whose ends both pass node_ok."""
    good = entities.filter(node_ok).select("id")
    kept = edges.filter(edge_ok).join(good.withColumnRenamed("id", "src"), "src", "left_semi").join(good.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return components(kept)


def levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, origem, nivel, anterior): breadth-first expansion from every seed (id) at once, up to depth hops.

    Each level joins the whole frontier at once. Of equal ways the least
    predecessor holds, so the result doesn't hang on the order of rows.
    """
    work = Work(edges.sparkSession, "bfs")
    near = work.save(undirected(edges.filter("src is not null and dst is not null")).distinct(), "near")
    reached = work.save(seeds.select("id").distinct().select("id", F.col("id").alias("origem"), F.lit(0).alias("nivel"), F.lit(None).cast("string").alias("anterior")), "level0")
    for k in range(1, depth + 1):
        frontier = reached.filter(F.col("nivel") == k - 1)
        new = frontier.join(near, frontier["id"] == near["node"]).groupBy(F.col("other").alias("id"), "origem").agg(F.min("node").alias("anterior"))
        fresh = new.join(reached.select("id", "origem"), ["id", "origem"], "left_anti").select("id", "origem", F.lit(k).alias("nivel"), "anterior")
        nxt = work.save(reached.unionByName(fresh), f"level{k}")
        grown = nxt.filter(F.col("nivel") == k).isEmpty()
        work.drop(reached)
        reached = nxt
        if grown:
            break
    return reached


def bridges(edges: DataFrame, targets: DataFrame, depth: int = 6) -> DataFrame:
    """(de, para, saltos, elo_mais_fraco, caminho) for each pair of targets linked within depth hops, de < para.

    A path is as strong as its weakest hop, a hop as its strongest edge.
    """
    work = Work(edges.sparkSession, "bridges")
    tree = work.save(levels(edges, targets, depth), "tree")
    hop = undirected(edges, "confidence").groupBy("node", "other").agg(F.max("confidence").alias("c"))
    hop = work.save(hop, "hops")
    ends = targets.select(F.col("id").alias("para")).distinct()
    walk = tree.join(ends, tree["id"] == ends["para"]).filter("nivel > 0 and origem < para").select(F.col("origem").alias("de"), "para", F.col("nivel").alias("saltos"), F.col("id").alias("at"), "anterior", F.array("id").alias("caminho"), F.lit(1.0).alias("elo_mais_fraco"))
    done = None
    for k in range(depth):
        step = walk.join(hop, (walk["at"] == hop["other"]) & (walk["anterior"] == hop["node"]), "left").select("de", "para", "saltos", F.col("anterior").alias("at"), F.concat(F.array("anterior"), "caminho").alias("caminho"), F.least("elo_mais_fraco", F.coalesce("c", F.lit(0.0))).alias("elo_mais_fraco"))
        step = work.save(step, f"walk{k}")
        there = step.filter("at = de").select("de", "para", "saltos", F.round("elo_mais_fraco", 4).alias("elo_mais_fraco"), "caminho")
        done = there if done is None else done.unionByName(there)
        t = tree.select(F.col("id").alias("at"), F.col("origem").alias("de"), "anterior")
        walk = step.filter("at <> de").join(t, ["at", "de"])
    return done


def merge_entities(rows: DataFrame, key: str, order: str, attributes: list[str], label: str = "label", target: str | None = None) -> DataFrame:
    """One row of each key: of every attribute the last value that isn't null or empty, the first such label, and
    whether any row was a target."""
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    out = [F.max_by(c, F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in attributes]
    out.append(F.min_by(label, F.when(filled(label).isNotNull(), F.col(order))).alias(label))
    if target:
        out.append(F.bool_or(F.coalesce(target, F.lit(False))).alias(target))
    return rows.groupBy(key).agg(*out)


def merge_evidence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, as evidence given twice counts once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge columns, falta): edges with an end that is no entity."""
    ids = entities.select(F.col("id"))
    a = edges.join(ids, edges["src"] == ids["id"], "left_anti").withColumn("falta", F.col("src"))
    b = edges.join(ids, edges["dst"] == ids["id"], "left_anti").withColumn("falta", F.col("dst"))
    return a.unionByName(b)


def correlation_table(edges: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """One flat row of each edge with its ends, level, sources and evidence (the first 300 signs)."""
    e = evidence.groupBy("edge_id").agg(
        F.count(F.lit(1)).alias("corroboracoes"),
        F.array_join(F.array_sort(F.collect_set("grade")), ",").alias("graus"),
        F.array_join(F.array_sort(F.collect_set("collector")), ";").alias("coletores"),
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "note"))), lambda s: s["note"]), "; "), 1, 300).alias("evidencia"),
    )
    s = entities.select(F.col("id").alias("src"), F.col("value").alias("entidade"), F.col("kind").alias("tipo"))
    d = entities.select(F.col("id").alias("dst"), F.col("value").alias("vinculada_a"), F.col("kind").alias("tipo_vinculo"))
    return edges.join(s, "src").join(d, "dst").join(e, edges["id"] == e["edge_id"], "left").drop("edge_id", "src", "dst")


def content_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """(hash): of all rows, whatever their order: the hash of the sorted row hashes, in two steps so that no task holds all."""
    h = rows.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    part = h.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("g"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "g"))), lambda s: s["g"]), ""), 256).alias("hash"))
