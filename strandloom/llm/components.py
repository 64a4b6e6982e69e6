"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, sized

#: Labels that are broadcast at most (16 bytes each), beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """edges (a, b) -> (id, comp) for every end of an edge; comp is the smallest id that it reaches.

    Each round takes the smallest label among neighbours and then the label's own label, so paths shrink by half at
    least. tasks: how many suffice for a table of edges. Minima are aggregated, never gathered, so a hub is no special case. A null end makes no edge.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = cut(both.select("a", "b").union(both.select("b", "a")).distinct(), "component-edges", tasks)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "component-labels", tasks)
    while True:
        near = both.join(sized(labels, MOST_BROADCAST).withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("low"))
        lower = sized(labels, MOST_BROADCAST).join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        lower = cut(lower, "component-labels", tasks)
        jump = sized(lower, MOST_BROADCAST).select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        # Every label is some vertex's id, and few labels are far from their end.
        new = cut(lower.join(jump, "comp").select("id", "was", F.col("far").alias("comp")), "component-labels", tasks)
        labels = new.select("id", "comp")
        if new.where("comp <> was").isEmpty():
            return labels
