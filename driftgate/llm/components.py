"""Connected components by alternating stars, each round a pair of written tables."""

from pyspark.sql import DataFrame, functions as F

from driftgate.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller and own) neighbours of a node to its least neighbour.

    The least neighbour is a minimum, combined before the exchange. It is written and joined back
    to the edges, so a node with very many neighbours is never collected and both sides of the join
    come straight from an exchange, where adaptive execution can split that node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v <= u")
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")), "star-least")
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialize(out.where("a != b").distinct(), "star")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (node, component), the least node that can be reached, for every node
    with a link to another."""
    edges = materialize(links.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        edges = _star(_star(edges, True), False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = now
