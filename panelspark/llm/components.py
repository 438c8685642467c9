"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import HOT_ROWS, cut, heaviest, looked_up


def connected(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """edges (a, b) of longs -> (id, root): every vertex that has an edge to another one, with the smallest vertex it reaches.

    Self-loops and repeated edges don't matter; null ends are left out; no edges, no rows. A round shuffles the edges
    by vertex; minima are pre-aggregated, so a vertex of any degree sends one row a task. A round never adds edges, and
    what it repeats falls together in the next one, so nothing is made distinct on the way. The minima of hubs, vertices
    with over ``hot_rows`` edges, are broadcast (``looked_up``), so a hub's edges stay where they are.

    Done are stars: no vertex with a smaller neighbour has another one. The aggregate that tells so is the one that the
    next round starts from, or the result.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.count("*").alias("degree")))
        state = ends.agg(F.bool_or(F.expr("m < u and top > m")), F.max("degree")).head()
        if not state[0]:
            return ends.select(F.col("u").alias("id"), F.least("u", "m").alias("root"))
        # A vertex has no more edges in ``large`` than in ``both``: what isn't a hub here isn't one there.
        hubs = heaviest(ends, ["u"], "degree", hot_rows) if state[1] > hot_rows else None
        meet = lambda rows, found: rows.join(found, "u") if hubs is None else looked_up(rows, found, ["u"], hubs)  # noqa: B023, E731
        low = ends.select("u", F.least("u", "m").alias("m"))
        large = meet(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))))
