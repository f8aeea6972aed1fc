"""Connected components of a graph given as edges, by contraction: nothing is gathered on the driver.

Each round maps every node to the least node among itself and its neighbours, follows that map once more, and
contracts the edges. Rounds end when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, hot_join, stash, unstash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); ``root`` is the least node of its component.

    Self-loops, repeated edges and nulls are allowed and add nothing. An empty table gives no rows.
    """
    edges = stash(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    roots = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc-step")
        total = edges.count() + 1
        # many nodes point to one hub: its rows are dealt over several tasks, and so are the edges of hubs below
        hubs = stash(step.groupBy("m").agg(F.count("*").alias("h")), "cc-hubs")
        to = step.select(F.col("u").alias("m"), F.col("m").alias("m2")).join(hubs, "m")
        two = stash(hot_join(step, to, ["m"], F.col("h") > total * HOT, ["u"]).select("u", F.col("m2").alias("m"), "n"), "cc-two")
        hot = F.col("n") > total * HOT
        if roots is None:
            new_roots = stash(two.select(F.col("u").alias("node"), F.col("m").alias("root")), "cc-roots")
        else:
            held = stash(roots.groupBy("root").agg(F.count("*").alias("h")), "cc-held")
            to = two.select(F.col("u").alias("root"), "m").join(held, "root")
            x = hot_join(roots, to, ["root"], F.col("h") > roots.count() * HOT, ["node"], "left")
            new_roots = stash(x.select("node", F.coalesce("m", "root").alias("root")), "cc-roots")
            unstash(roots, held)
        a, b = two.select("u", F.col("m").alias("a"), "n"), two.select(F.col("u").alias("v"), F.col("m").alias("b"), "n")
        x = hot_join(edges, a, ["u"], hot, ["v"]).drop("n")
        x = hot_join(x, b, ["v"], hot, ["u"]).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        new_edges = stash(x, "cc-edges")
        unstash(edges, step, hubs, two)
        edges, roots = new_edges, new_roots
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
