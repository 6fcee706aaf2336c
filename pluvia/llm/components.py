"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.storage import remove, scratch_folder


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _written(edges: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_folder(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), path


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of an edge; root is the smallest node reachable. Edges: u, v (long).

    Each round is two joins and two aggregations with partial sums; a hub's edges may be split over
    tasks. The rounds needed grow with the logarithm of the longest path, not with the edges. Each round's
    edges are written to the shared folder, and those of the round before are deleted.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges, path = _written(ordered)
    before = _signature(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # After the large star every edge leads from the larger node to a smaller one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, new = _written(small)
        remove(edges.sparkSession, path)
        path, after = new, _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
