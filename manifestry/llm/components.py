"""Connected components of an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Most hubs: nodes with more than 1 in HUBS of all links, so there are at most 2 x HUBS of them.
HUBS = 10_000


def _least(edges: DataFrame) -> DataFrame:
    """(a, m, n): for each node of ``a`` the least of its neighbours ``b``, and how many links it has."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _with_least(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """(a, b, m): each link with its node's least neighbour.

    The links of hubs, which would all meet in one task, are joined where they lie: there are at most 2 x HUBS
    hubs, as each holds more than 1 in HUBS of the ``links`` (either end of which may be ``a``).
    """
    most = max(links // HUBS, 10_000)
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
    others = edges.join(F.broadcast(least.where(F.col("n") > most).select("a")), "a", "left_anti")
    return edges.join(hubs, "a").unionByName(others.join(least.select("a", "m"), "a"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each halves the depth of the trees or better, so long chains
    end in a logarithmic number of rounds.  They end when a round has the same links as the one before; if
    ``max_rounds`` do not suffice, an error is raised, never a part of the answer given.  A hub's edges are
    only joined with its minimum (a map-side combined aggregate), never gathered, and each round's edges are
    written to the shared checkpoint folder.  Null ends and self links are dropped; repeated links count once;
    no edges give an empty result; further columns are not read.
    """
    a, b = F.col("a"), F.col("b")
    now = checkpoint(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    links = now.count()
    for _ in range(max_rounds):
        # large star: every neighbour above a node, to the least of the node and its neighbours
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = _least(both).withColumn("m", F.least("a", "m"))
        large = _with_least(both, least, links).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node and its neighbours below, to the least of these
        least = _least(large)
        joined = _with_least(large, least, links)
        small = joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        before, links_before = now, links
        now = checkpoint(small)
        links = now.count()
        if links == links_before and now.join(before, ["a", "b"], "left_anti").isEmpty():
            roots = now.select(b.alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(a.alias("node"), b.alias("component")).union(roots)
    raise RuntimeError(f"components still changed in round {max_rounds}: {links} links")
