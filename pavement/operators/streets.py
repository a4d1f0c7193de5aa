"""Street graphs: tiles merged, directions dropped, chains of nodes contracted to streets.

A node is inside a street if exactly two edges end there and lead to two different
nodes; all others are junctions (dead ends, crossings, nodes with a loop). Chains are
followed by pointer doubling over directed edges, so a chain of n edges takes about
log2(n) rounds, each one join of the pointers that are not at their end yet. Every
round is written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.plans.storage import written


def merged_edges(edges: DataFrame, key: str = "city", u: str = "u", v: str = "v", way: str = "way",
                 length: str = "length_m") -> DataFrame:
    """(key, a, b, way, length, eid): every edge once, whichever tiles and directions it came in.

    An edge is named by its two nodes and its way; if tiles differ, the shortest
    length counts, and a null one is 0. Rows with a null node are left out.
    """
    low, high = F.least(u, v), F.greatest(u, v)
    once = (edges.where(F.col(u).isNotNull() & F.col(v).isNotNull())
            .groupBy(F.col(key).alias("key"), low.alias("a"), high.alias("b"), F.col(way).cast("string").alias("way"))
            .agg(F.coalesce(F.min(F.col(length).cast("double")), F.lit(0.0)).alias("length")))
    return once.withColumn("eid", F.md5(F.to_json(F.struct("key", "a", "b", "way"), {"ignoreNullFields": "false"})))


def _directed(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; the last sign of ``did`` is the direction."""
    ways = F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("end"), F.lit(">").alias("sign")),
                   F.struct(F.col("b").alias("start"), F.col("a").alias("end"), F.lit("<").alias("sign")))
    return (edges.select("key", "eid", "length", F.inline(ways))
            .select("key", "eid", "start", "end", "length", F.concat("eid", "sign").alias("did")))


def _turned(did: Column) -> Column:
    return F.concat(F.substring(did, 1, 32), F.when(F.endswith(did, F.lit(">")), "<").otherwise(">"))


def street_graph(edges: DataFrame, key: str = "city", u: str = "u", v: str = "v", way: str = "way",
                 length: str = "length_m") -> DataFrame:
    """(key, from_node, to_node, length_m, n_edges): one row per street between junctions.

    A ring without any junction is one street from its smallest node to itself.
    Parallel ways between the same nodes are different streets. An empty table has
    no streets. Tables are built while the plan is built.
    """
    directed = written(_directed(merged_edges(edges, key, u, v, way, length)))
    nodes = (directed.groupBy("key", F.col("start").alias("node"))
             .agg(F.count("*").alias("_ends"), F.count_distinct(F.when(F.col("end") != F.col("start"), F.col("end"))).alias("_others")))
    inside = written(nodes.where("_ends = 2 AND _others = 2").select("key", "node"))
    onward = (directed.join(inside.withColumnRenamed("node", "start"), ["key", "start"])
              .select("key", F.col("start").alias("end"), F.col("eid").alias("_eid"), F.col("did").alias("next")))
    first = (directed.join(onward, ["key", "end"], "left").where("next IS NULL OR _eid <> eid")
             .select("key", "did", "start", "end", "length", F.col("did").alias("last"), "next", F.lit(1).cast("long").alias("n_edges"),
                     F.when(F.col("next").isNotNull(), F.col("end")).alias("low")))
    ended, open_ = [], written(first)
    before = None
    while True:
        ended.append(open_.where("next IS NULL"))
        going = open_.where("next IS NOT NULL")
        state = tuple(going.agg(F.count("*"), F.expr("bit_xor(xxhash64(did, low))")).first())
        if state[0] == 0 or state == before:
            break
        before = state
        # those ahead may have ended in an earlier round
        ahead = ended[0]
        for part in ended[1:]:
            ahead = ahead.unionByName(part)
        ahead = ahead.unionByName(going).select(
            F.col("did").alias("next"), *[F.col(c).alias(f"_{c}") for c in ("end", "length", "last", "next", "n_edges", "low")])
        open_ = written(going.join(ahead, "next").select(
            "key", "did", "start", F.col("_end").alias("end"), (F.col("length") + F.col("_length")).alias("length"), F.col("_last").alias("last"),
            F.col("_next").alias("next"), (F.col("n_edges") + F.col("_n_edges")).alias("n_edges"), F.least("low", "_low").alias("low")))
    whole = ended[0]
    for part in ended[1:]:
        whole = whole.unionByName(part)
    chains = (whole.join(inside.withColumnRenamed("node", "start"), ["key", "start"], "left_anti").where(F.col("did") <= _turned(F.col("last")))
              .select("key", F.col("start").alias("from_node"), F.col("end").alias("to_node"), F.col("length").alias("length_m"), "n_edges"))
    rings = (going.select("key", "did", "low").join(directed.select("did", F.col("length").alias("_one")), "did").groupBy("key", "low")
             .agg((F.sum("_one") / 2).alias("length_m"), (F.count("*") / 2).cast("long").alias("n_edges"))
             .select("key", F.col("low").alias("from_node"), F.col("low").alias("to_node"), "length_m", "n_edges"))
    return chains.unionByName(rings).withColumnRenamed("key", key)


def street_counts(streets: DataFrame, key: str = "city") -> DataFrame:
    """(key, node, street_count): how many streets end at each junction; a loop ends there twice."""
    return (streets.select(key, F.explode(F.array("from_node", "to_node")).alias("node"))
            .groupBy(key, "node").agg(F.count("*").alias("street_count")))
