"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import remove, saved


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, label): for each node of a link (columns a, b), the smallest node it reaches.

    Each round hooks neighbours to the smallest node around, so the number of rounds grows with the
    logarithm of a component's width. Minima are combined before the shuffle; every round's links
    are a table in the shared folder.
    """
    edges, k = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/edges0"), 0
    print_of = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = edges.agg(print_of).first()[0]
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        k += 1
        after = saved(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{path}/edges{k}")
        remove(links.sparkSession, f"{path}/edges{k - 1}")
        edges, now = after, after.agg(print_of).first()[0]
        if now == before:
            break
        before = now
    # now each edge joins a node to its component's smallest
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v"))).distinct()
