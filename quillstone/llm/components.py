"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _is_stars(e: DataFrame) -> bool:
    """Whether no vertex has two smaller neighbours, or one and a larger one too."""
    end = lambda c, below, above: F.struct(F.col(c).alias("x"), F.lit(below).alias("below"), F.lit(above).alias("above"))
    ends = e.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("s")).select("s.*")
    ends = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.agg(F.count_if(F.expr("below > 1 OR below = 1 AND above = 1"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex u that has an edge, with the smallest vertex v of its component. Edges are (u, v), of any direction, repeats and loops allowed.

    A large star links all larger neighbours of a vertex with the smallest vertex it knows, a small star the smaller
    ones and itself; both keep components whole and leave a star around each smallest vertex in the end, which is seen
    without a round more. Every round's edges are a table in the shared folder, no more of them than at first; none is
    gathered on the driver.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    return e.unionByName(e.select(F.col("v").alias("u"), "v").distinct())


def brought_together(answers: DataFrame, links: DataFrame) -> DataFrame:
    """Answers (vertex, comp), as components() gives them, once ``links`` (u, v) between some of their comps are known too.

    Only the comps that ``links`` names go through the rounds. A vertex without an answer is its own comp. ``links`` is
    read twice.
    """
    if links.isEmpty():
        return answers
    roots = components(links).select(F.col("u").alias("comp"), F.col("v").alias("root"))
    moved = answers.join(roots, "comp", "left").select("vertex", F.coalesce("root", "comp").alias("comp"))
    return moved.union(roots).distinct()
