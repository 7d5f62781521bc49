"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, freed


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) for every node of links(a long, b long).

    Nulls and self-links are left out.  Each step groups and joins the links; none is collected.  Ends
    when a round changes nothing, after O(log^2) rounds.
    """
    both = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = cut(both, "stars")
    before = None
    while True:
        two_way = stars.select("u", "v").union(stars.select("v", "u"))
        least = two_way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two_way.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", "m")).distinct()
        done, stars = stars, cut(small, "stars")
        freed(done)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.union(roots).select(F.col("u").alias("node"), F.col("v").alias("label"))
