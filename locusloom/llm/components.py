"""Connected components of a table of links, by alternating large and small stars.

Both stars are a minimum for each node and a join; no neighbourhood is ever gathered in one place. The minima
are broadcast while they are counted and few, else the joins shuffle. The links are written to the
checkpoint folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import cut

#: Links up to this number are joined by broadcasts; rows of a task when links are few.
FEW_LINKS, TASK_ROWS = 500_000, 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); a component's name is its least node.

    Defined results: null ends and links of a node to itself are ignored; repeated links count
    once; no links give no rows.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    links = cut(links.where("a <> b").select(hi, lo).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()  # one row
        if state == seen:
            break
        seen = state
        few = state[0] <= FEW_LINKS
        minima = F.broadcast if few else lambda df: df
        if few:
            links = links.coalesce(state[0] // TASK_ROWS + 1)
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of a node move to the least of its neighbourhood.
        large = both.join(minima(least), both["hi"] == least["u"]).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large if few else large.distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(minima(least), large["hi"] == least["u"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
