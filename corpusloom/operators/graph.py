"""Connected components by repeated contraction.

Each round maps every node to the least node of its neighbourhood (by id at first, by a hash that changes from round
to round later, so that no numbering of a long chain is slow), replaces edges by edges between those images and drops
loops and repeats. The edge table shrinks geometrically; the maps are composed backwards at the end. Nothing is
gathered on the driver, and hub nodes only meet a partial aggregation and joins that AQE can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusloom.plans.storage import Stash


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = the least node reachable.

    Nulls at either end are ignored, as are loops and repeated edges. An empty edge table gives an empty result.
    """
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b"))
    )
    current = Stash(pairs.distinct(), "edges")
    maps: list[Stash] = []
    while not current.df.isEmpty():
        k = len(maps)

        def order(c: str, k: int = k):
            return F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n")) if k else F.struct(F.col(c).alias("n"))

        both = current.df.select("a", "b").union(current.df.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        maps.append(Stash(least.select("u", F.least(order("u"), F.col("m"))["n"].alias("r")), "parents"))
        m = maps[-1].df
        e = current.df.join(m.toDF("a", "ra"), "a").join(m.toDF("b", "rb"), "b")
        e = e.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        following = Stash(e, "edges")
        current.drop()
        current = following
    if not maps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    roots = maps[-1].df.toDF("node", "root")
    for m in reversed(maps[:-1]):
        up = roots.toDF("r", "top")
        roots = m.df.join(up, "r", "left").select(F.col("u").alias("node"), F.coalesce("top", "r").alias("root"))
    done = Stash(roots, "roots")
    for m in maps:
        m.drop()
    current.drop()
    names = Stash(done.df.groupBy("root").agg(F.min("node").alias("component")), "components")
    return done.df.join(names.df, "root").select("node", "component")


def spanning_links(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places below n, links (place, least place of its connected set) that connect the same sets: at most n."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]
