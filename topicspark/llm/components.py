"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topicspark.llm.stages import Steps


def _roots(steps: Steps, parents: DataFrame, name: str) -> DataFrame:
    """Follows parents (smaller ids) to the root of every node, twice as far with each step."""
    for k in range(64):
        far = parents.alias("n").join(parents.alias("p"), F.col("n.root") == F.col("p.node"), "left").select(
            F.col("n.node").alias("node"), F.coalesce("p.root", "n.root").alias("root"),
            (F.col("p.root") < F.col("n.root")).alias("moved"))
        far = steps.save(far, f"{name}-{k}")
        parents = far.select("node", "root")
        if far.where("moved").isEmpty():
            return parents
    raise RuntimeError("a chain of more than 2 ** 64 nodes")


def components(steps: Steps, links: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node that has a link or is in `known`; the root is the smallest node of the component.

    `links` has columns a and b.  Each round hangs every root under its smallest neighbour, follows the new parents to their
    roots and replaces the ends of the links by them; links inside a component vanish.  A round at least halves the roots
    that still have links.  `known` are components of earlier links (one row per node, roots included or not).
    """
    labels = known
    for k in range(64):
        if labels is not None:
            to = labels.select(F.col("node"), F.col("root"))
            links = (links.join(to.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left")
                     .join(to.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
                     .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        links = steps.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                           f"{name}-links-{k}")
        if links.isEmpty():
            return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = steps.save(both.groupBy("node").agg(F.min("other").alias("other"))
                             .select("node", F.least("node", "other").alias("root")), f"{name}-parents-{k}")
        roots = _roots(steps, parents, f"{name}-roots-{k}")
        if labels is None:
            labels = roots
            continue
        # nodes known from before follow their root; roots that were no node of `known` come in new
        moved = labels.select("node", F.col("root").alias("was")).join(
            roots.select(F.col("node").alias("was"), F.col("root").alias("now")), "was", "left").select(
            "node", F.coalesce("now", "was").alias("root"))
        fresh = roots.join(labels.select("node"), "node", "left_anti")
        labels = steps.save(moved.unionByName(fresh), f"{name}-labels-{k}")
    raise RuntimeError("components did not settle")
