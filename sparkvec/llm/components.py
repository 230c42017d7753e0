"""Connected components of a large graph by joins: every node gets the least id that it reaches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label for all nodes of edges(a, b). Labels of neighbours are taken over and then followed once, until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both.where("a <> b"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        taken = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("next"), F.col("label").alias("was"))
        taken = written(taken)
        ahead = taken.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
        moved = taken.join(ahead, F.col("next") == F.col("via"), "left")
        moved = written(moved.select("node", F.least("next", "beyond").alias("label"), "was"))
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
