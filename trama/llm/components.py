"""Group ids from pairwise links, by low-diameter decomposition.

Every vertex draws a shift from an exponential distribution (a hash of its id,
so reruns agree) and starts to grow a cluster the earlier the larger its shift
is; a vertex joins the cluster that reaches it first, one hop taking one unit of
time. Rounds go on until no vertex is reached earlier than before, so shifts are
whole and clusters are those of the exact decomposition, whose radius is bounded
by the greatest shift, about log(n) / BETA. Clusters become the vertices of the
next, smaller graph, whose edges are the links between clusters (about a part
BETA of a chain's, far fewer of a dense part's); this repeats until no link is
left, and the assignments are composed from the last level to the first.

Only vertices reached earlier in a round send in the next, so all rounds of a
level send about as many messages as five times its edges, whatever their number.

Hubs: a vertex that holds a large part of all rows is dealt into pieces, linked
to it by hops that take no time; look-ups of large clusters use slots
(operators.hot_join). Messages combine on the map side. Levels and rounds run in
a session with static plans, without relations built in the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trama.operators.hot_join import SLOTS, hot_keys, hot_lookup
from trama.session import Work, steady

#: Rate of the exponential shifts: the part of a chain's links that a level leaves, about.
BETA = 0.2
#: Low bits of a vertex's number, for its pieces.
BITS = SLOTS.bit_length() - 1


def clean_links(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): ends that are null or empty make the row no link."""
    return links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter((F.col("a") != "") & (F.col("b") != ""))


def _numbered(ok: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """(vertices v, id), (edges a < b of ids, each once). Numbers are whole multiples of SLOTS, exact and not hashes."""
    vertices = work.save(ok.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("id", F.shiftleft(F.monotonically_increasing_id(), BITS)), "vertices")
    proper = ok.filter("a <> b")
    hot = hot_keys(proper.select(F.explode(F.array("a", "b")).alias("v")), "v")
    one = hot_lookup(proper, "a", "b", vertices.select(F.col("v").alias("a"), F.col("id").alias("ia")), hot).select("ia", "b")
    two = hot_lookup(one, "b", "ia", vertices.select(F.col("v").alias("b"), F.col("id").alias("ib")), hot)
    return vertices, work.save(two.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct(), "edges0", n=F.count(F.lit(1)))


def _hops(edges: DataFrame, hot: list, parts: int) -> DataFrame:
    """(s, d, w): both directions of each edge between the pieces of its ends, and between hubs and their pieces, and a
    hop from each to itself, by which it keeps its label; by s."""

    def piece(x: str, other: str) -> Column:
        return F.col(x) + F.when(F.col(x).isin(hot), F.pmod(F.xxhash64(other), F.lit(SLOTS))).otherwise(F.lit(0)) if hot else F.col(x)

    one = edges.select(piece("a", "b").alias("s"), piece("b", "a").alias("d"), F.lit(1.0).alias("w"))
    if hot:
        own = edges.sparkSession.createDataFrame([(h,) for h in hot], "s bigint")
        one = one.unionByName(own.select("s", F.explode(F.sequence(F.lit(1), F.lit(SLOTS - 1))).alias("k")).select("s", (F.col("s") + F.col("k")).alias("d"), F.lit(0.0).alias("w")))
    both = one.unionByName(one.select(F.col("d").alias("s"), F.col("s").alias("d"), "w"))
    return both.unionByName(both.select("s", F.col("s").alias("d"), F.lit(0.0).alias("w")).distinct()).repartition(parts, "s")


def _level(edges: DataFrame, level: int, n: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """(clusters v, c), (the links between different clusters, each once)."""
    spark = work.spark
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(edges.select(F.explode(F.array("a", "b")).alias("v")), "v", 2 * n)
    hops = _hops(edges, hot, parts).persist()
    u = (F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # all shifts are below this, so starts are positive
    start = F.lit(52 * math.log(2) / BETA) + F.log(u) / F.lit(BETA) + 1
    vertex = F.col("v").bitwiseAND(F.lit(SLOTS - 1)) == 0
    label = hops.filter("s = d").select(F.col("s").alias("v")).select("v", F.when(vertex, start).otherwise(F.lit(math.inf)).alias("t"), F.col("v").alias("c"), vertex.alias("fresh"))
    rounds = max(3, round(math.log(n)))
    while True:
        for _ in range(rounds):
            at = label.withColumnRenamed("v", "s").hint("shuffle_hash")
            sent = hops.join(at, (hops["s"] == at["s"]) & (at["fresh"] | (hops["s"] == hops["d"]))).select(F.col("d").alias("v"), (F.col("t") + F.col("w")).alias("t"), "c", F.when(hops["s"] == hops["d"], F.col("t")).alias("before"))
            label = sent.groupBy("v").agg(F.min("t").alias("t"), F.min_by("c", "t").alias("c"), F.min("before").alias("before")).select("v", "t", "c", (F.col("t") < F.col("before")).alias("fresh"))
        done = work.save(label, f"clusters{level}", fresh=F.bool_or("fresh"), n=F.count_if(vertex))
        label = done.repartition(parts, "v")
        if not done.figures["fresh"]:
            break
    # of the two directions of an edge one; those between a hub and its pieces too, should a tie have parted them
    one = hops.filter("s < d").join(label.select(F.col("v").alias("s"), F.col("c").alias("a")).hint("shuffle_hash"), "s").select("a", F.col("d").alias("v"))
    two = one.join(label.select("v", F.col("c").alias("b")).hint("shuffle_hash"), "v").filter("a <> b")
    smaller = work.save(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{level + 1}", n=F.count(F.lit(1)))
    hops.unpersist()
    clusters = done.filter(vertex).select("v", "c")
    clusters.figures = done.figures
    return clusters, smaller


def group_ids(links: DataFrame, a: str = "origem", b: str = "destino") -> DataFrame:
    """(entidade, grupo): each entity with the smallest id of all it is linked to over any number of links.

    Rows with a null or empty end are no links. Repeated, reversed and self
    links are allowed; an entity linked only to itself is its own group. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = links.sparkSession
    outer = Work(spark, "components")
    vertices, edges = _numbered(clean_links(links, a, b), outer)
    n = edges.figures["n"]
    own = steady(spark)
    work = Work(own, "components")
    edges = work.load(edges, own)
    levels: list[DataFrame] = []
    while n:
        clusters, smaller = _level(edges, len(levels), n, work)
        levels.append(clusters)
        work.drop(edges)
        edges, n = smaller, smaller.figures["n"]
    if not levels:
        return vertices.select(F.col("v").alias("entidade"), F.col("v").alias("grupo"))
    top = levels.pop()
    while levels:
        clusters = levels.pop()
        up = top.select(F.col("v").alias("c"), F.col("c").alias("r"))
        top = hot_lookup(clusters, "c", "v", up, hot_keys(clusters, "c", clusters.figures["n"]), "left").select("v", F.coalesce("r", "c").alias("c"))
    ids = work.load(vertices, own)
    named = ids.join(top.select(F.col("v").alias("id"), F.col("c").alias("r")), "id", "left").select("v", F.coalesce("r", "id").alias("r"))
    root = outer.load(work.save(named, "root"), spark)
    names = root.groupBy("r").agg(F.min("v").alias("grupo"))
    return hot_lookup(root, "r", "v", names, hot_keys(root, "r")).select(F.col("v").alias("entidade"), "grupo")
