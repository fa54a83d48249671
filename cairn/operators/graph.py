"""The entity graph: edges kept as values, found by entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.skew import salted_lookup

EDGE = "from string, to string, relation string, date string"
MOST = 500


def stored(edges: DataFrame) -> DataFrame:
    """key, value, text of edges (src, dst, relation, date)."""
    key = F.concat(F.lit("memory/graph/"), "date", F.lit("-"), "src", F.lit("-"), "dst", F.lit("-"), "relation")
    value = F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "relation", "date"))
    return edges.select(key.alias("key"), value.alias("value"), F.concat(F.lit("graph: "), "src", F.lit(" --["), "relation", F.lit("]--> "), "dst").alias("text"))


def read(kv: DataFrame) -> DataFrame:
    """key, src, dst, relation, date of the values under the graph's keys; what is no edge is left out."""
    e = kv.where(F.col("key").startswith("memory/graph/") & ~F.col("key").endswith("/")).select("key", F.from_json("value", EDGE).alias("e"))
    return e.where(F.col("e.from").isNotNull() & F.col("e.to").isNotNull()).select("key", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.relation", "e.date")


def touching(edges: DataFrame, entity: str) -> DataFrame:
    """Edges one of whose ends holds the entity's name, letters as written."""
    return edges.where(F.contains("src", F.lit(entity)) | F.contains("dst", F.lit(entity)))


def neighbours(edges: DataFrame, entity: str, limit: int = MOST) -> DataFrame:
    """neighbour, relation, direction of the entity itself, over the first `limit` edges by key that hold its name."""
    e = touching(edges, entity).orderBy("key").limit(limit)
    out = e.where(F.col("src") == entity).select(F.col("dst").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    back = e.where(F.col("dst") == entity).select(F.col("src").alias("neighbour"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(back)


def chains(edges: DataFrame) -> DataFrame:
    """a, via, b: entities two edges apart in the edges' direction. The edges into a hub are spread over salts, so that no task makes all of its chains."""
    x, y = edges.select(F.col("src").alias("a"), F.col("dst").alias("via")).distinct(), edges.select(F.col("src").alias("via"), F.col("dst").alias("b")).distinct()
    return salted_lookup(x, y, "via", F.col("a"), how="inner").select("a", "via", "b")


def reach(edges: DataFrame, entity: str, depth: int = 2) -> DataFrame:
    """entity, hops: what at most `depth` edges lead to in either direction, with the fewest hops; the entity itself has none."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    levels = [edges.sparkSession.createDataFrame([(entity, 0)], "entity string, hops int")]
    for k in range(1, depth + 1):
        step = levels[-1].join(both, F.col("entity") == F.col("x")).select(F.col("y").alias("entity"), F.lit(k).alias("hops")).distinct()
        for known in levels:
            step = step.join(known.select("entity"), "entity", "left_anti")
        levels.append(step)
    return reduce(DataFrame.unionByName, levels)
