"""Connected components of a graph given by its links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import cut


def _jumped(parents: DataFrame) -> DataFrame:
    """Follows parents to the roots by pointer jumping: the depth halves each round."""
    while True:
        child, grand = parents.alias("c"), parents.alias("g")
        step = cut(child.join(grand, F.col("c.parent") == F.col("g.node"), "left").select(F.col("c.node").alias("node"), F.coalesce("g.parent", "c.parent").alias("parent"), (F.coalesce("g.parent", "c.parent") != F.col("c.parent")).alias("moved")), "jump")
        parents = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the smallest node that can be reached.

    Each round points every node to its smallest neighbour, follows the pointers to their roots and
    contracts the links to links between roots. Only nodes that are smaller than all their neighbours
    stay, so rounds grow with the logarithm of a component's size. Minima are combined before the
    shuffle, which makes repeated links cheap: they are not looked for. Joins on a node with many links
    meet one row of the other side, and adaptive execution can split them.
    """
    links = cut(links.where("a <> b").select("a", "b"), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parents = _jumped(cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "parents"))
        p, q = parents.alias("p"), parents.alias("q")
        links = cut(
            links.join(p, F.col("a") == F.col("p.node")).join(q, F.col("b") == F.col("q.node")).select(F.col("p.parent").alias("a"), F.col("q.parent").alias("b")).where("a <> b"),
            "links",
        )
        if roots is None:
            roots = parents
        else:
            r = roots.alias("r")
            roots = cut(r.join(p, F.col("r.parent") == F.col("p.node"), "left").select("r.node", F.coalesce("p.parent", "r.parent").alias("parent")), "roots")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.select("node", F.col("parent").alias("root"))


def extended_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of the links that gave roots (None: none) and of further links; only links between components are followed."""
    if roots is None:
        return connected_components(links)
    p, q = roots.alias("p"), roots.alias("q")
    between = links.join(p, F.col("a") == F.col("p.node"), "left").join(q, F.col("b") == F.col("q.node"), "left").select(F.coalesce("p.root", "a").alias("a"), F.coalesce("q.root", "b").alias("b"))
    joined = connected_components(between)
    if joined.isEmpty():
        return roots
    j = joined.alias("j")
    old = p.join(j, F.col("p.root") == F.col("j.node"), "left").select("p.node", F.coalesce("j.root", "p.root").alias("root"))
    return cut(old.union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
