"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Nodes whose minimum is broadcast: fewer than this many have more than that share of all edges.
HOT = 5_000
#: Edges of one node that a task meets in any case.
FEW = 1_000
#: Edges of a graph that need no such care: a task can meet all of them.
SMALL = 100_000


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the least v of their u as ``m``.

    Of at most ``SMALL`` edges a window is enough, one shuffle.  Else minima are
    taken map-side first, and a node with more than ``total / HOT`` of
    the ``total`` edges meets its minimum by broadcast (there are fewer than
    ``HOT`` such nodes), so its edges don't gather in a task.
    """
    if total <= SMALL:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    limit = max(FEW, -(-total // HOT))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = least.filter(F.col("n") > limit).select("u", "m")
    met = edges.join(F.broadcast(hot), "u", "left")
    rest = met.filter("m IS NULL").select("u", "v").join(least.filter(F.col("n") <= limit).select("u", "m"), "u")
    return met.filter("m IS NOT NULL").select("u", "v", "m").union(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that has an edge.

    ``edges`` has two columns of one orderable type, in either direction, with
    repeats and loops allowed; null ends are ignored.  Returns (node, component).

    Alternates the large-star and small-star steps: each hangs a node's
    neighbours on the smallest of them, so a component becomes a star around its
    smallest node in a number of rounds that grows with the logarithm of its
    size.  Each round is checkpointed in the shared folder.  Nothing but a
    convergence flag reaches the driver.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct().checkpoint()
    state = before = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: larger neighbours of a node move to the smallest of its neighbourhood
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = with_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: smaller neighbours and the node itself move to the smallest of them
        hung = with_least(large, 2 * state[0])
        now = hung.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).filter("u > v").distinct().checkpoint()
        before, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
