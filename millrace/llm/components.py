"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a join of two stored tables, so a node with very many links is split over tasks by the skew join, and a
lost executor costs no recomputation of earlier rounds. Nothing but two sums per round reaches the driver.

Defined results: repeated links, links in both directions and links of a node to itself change nothing; links with a null are left
out; an empty table gives no rows. There are no ties: a component's root is its least node. Columns besides a and b aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _star(links: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """links (u > v). Large: larger neighbours of each node go to its least one. Small: the others do."""
    if large:
        sides, a = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star-sides")
    else:
        sides, a = links, ""
    least, b = stored(sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star-least")
    met = sides.join(least, sides["u"] == least["k"])
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    out, c = stored(out.filter("u <> v").distinct(), "star-links")
    forget(links.sparkSession, *filter(None, (a, b)))
    return out, [c]


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of any orderable type, in either direction, repeats allowed. Returns (node, root) for every node
    but the roots, root being the least node reachable. No links give no rows."""
    spark = links.sparkSession
    now, path = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    while True:
        for large in (True, False):
            after, (written,) = _star(now, large)
            forget(spark, path)
            now, path = after, written
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (found.n, found.h)
