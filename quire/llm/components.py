"""Connected components of links, as rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.session import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``root``, the smallest id that links reach, for every id in ``links`` (columns
    ``x`` and ``y``, in either order, repeated or not).

    Each round hangs every larger neighbour of an id below the id's smallest neighbour (large
    star), then every smaller one (small star), until all ids hang below their roots. A round's
    links are no more than those before it; they are never collected. Least neighbours are staged,
    so that Spark can split the join of an id that has most of the links.
    """
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    edges = staged(edges.where("u <> v").distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
