"""Connected components of a links table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.store import kept


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable, itself included.

    Alternates two star steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones. Each round is two
    aggregations and joins with the links alone; chains halve, so the number of
    rounds grows with the logarithm of the longest path. Loops and repeated links are ignored; a null
    end links nothing. The joins are merge joins whatever the sizes, as dozens of
    rounds of broadcasts would pile up in the driver.
    """
    edges = (
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = kept(edges, "components")
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours of u are linked to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of u, and u, are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = (
            joined.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = kept(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return found.union(roots.join(found.select("node").hint("merge"), "node", "left_anti"))
