"""Connected components of a distributed list of links."""

from pyspark.sql import DataFrame, functions as F

from riskmart.llm.storing import kept


def components(links: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component): the smallest node reachable from each linked node.

    Alternates two steps until nothing changes: every node ties its larger neighbours to
    its smallest one, then every node ties its smaller neighbours to the smallest. Both
    keep the components, and a hub's neighbours are reduced to a minimum before any join,
    so no neighbourhood is gathered in one place. Nodes without links are not listed.
    """
    ties = kept(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    while True:
        both = ties.select("u", "v").union(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("t")
        ).select("t.u", "t.v").where("u <> v").distinct()
        after = kept(small)
        same = after.count() == ties.count() and after.join(ties, ["u", "v"], "left_anti").isEmpty()
        ties = after
        if same:
            break
    return ties.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        ties.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
