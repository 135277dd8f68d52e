"""Connected components of an edge table by repeated hooking and pointer jumping.

Each round is two written tables: the smallest parent of every vertex, and the edges that are left after each vertex
has been moved to its parent's parent and each other parent has been hooked to the smallest. Rounds grow with the
logarithm of the longest chain. Aggregates combine before the shuffle, and joins read written tables on both sides, so
that adaptive execution can split the partition of a vertex with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component): component is the smallest vertex reachable; vertices without a link have no row.

    Self links are ignored; repeated links and both directions of one are the same link; null ends link nothing.
    An empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    links = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("p")).distinct()
    links = stored(links, "links")
    for _ in range(max_rounds):
        best = stored(links.groupBy("v").agg(F.min("p").alias("p"), F.count("*").alias("n")), "parents")
        up = best.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = best.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        many = best.where("n > 1").select("v", F.col("p").alias("q"))
        hooked = links.join(many, "v").where("p != q").select(F.col("p").alias("v"), F.col("q").alias("p"), F.lit(True).alias("moved"))
        links = stored(jumped.unionByName(hooked).groupBy("v", "p").agg(F.max("moved").alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = links.select(F.col("p").alias("vertex"), F.col("p").alias("component")).distinct()
    return links.select(F.col("v").alias("vertex"), F.col("p").alias("component")).unionByName(own)


class Links:
    """Union-find over local positions with numpy; used inside one shard or block."""

    def __init__(self, n: int):
        import numpy as np

        self.np, self.parent = np, np.arange(n)

    def find(self, x):
        p = self.parent
        up = p[x]
        while True:
            top = p[up]
            if (top == up).all():
                return up
            up = top

    def union(self, a, b) -> None:
        """Links a[i] with b[i] for all i; the smaller position becomes the root."""
        np = self.np
        while len(a):
            a, b = self.find(a), self.find(b)
            keep = a != b
            a, b = a[keep], b[keep]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)

    def roots(self):
        return self.find(self.np.arange(len(self.parent)))
