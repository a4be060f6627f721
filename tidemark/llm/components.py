"""Connected components over an edge table, without collecting edges or labels.

Each round hooks every node's label, and its label's label, to the smallest label next to it and
then jumps pointers once. Long chains halve, so rounds grow with the logarithm of the diameter.
The labels are written to the shared folder after each round; all but the last table are removed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, one integer type).

    root is the smallest node reachable. Loops and repeated edges do no harm; rows with a null end
    are ignored; an empty table gives an empty result.
    """
    own = Scratch(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = own.written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = own.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        seen = own.written(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low")), "seen")
        offers = seen.select("node", "low").unionByName(seen.select(F.col("root").alias("node"), "low"))
        hooked = own.written(offers.groupBy("node").agg(F.min("low").alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = own.written(
            hooked.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels"
        )
        moved = new.join(labels.withColumnRenamed("root", "old"), "node").where("old <> root").limit(1).count()
        labels = new
        if not moved:
            done = written(labels, "components")
            own.remove()
            return done
