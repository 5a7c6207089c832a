"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loggrove.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the smallest node reachable) of every node in ``links`` (a, b).

    Each round a node takes the smallest label among its neighbours' and its own, then the label
    of that label, so labels travel twice as far each round. Minima are combined before the
    shuffle and the join on a hub's id is split at run time, so hubs need no task of their own.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        named = labels.select(F.col("node").alias("b"), F.col("comp").alias("seen"))
        lowest = both.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(lowest, "node").select("node", F.least("comp", "seen").alias("next"), "comp")
        of_label = labels.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        moved = written(hooked.join(of_label, "next").select("node", F.least("next", "further").alias("comp"), F.col("comp").alias("before")), "labels")
        labels = moved.select("node", "comp")
        if moved.where("comp <> before").isEmpty():
            return labels
