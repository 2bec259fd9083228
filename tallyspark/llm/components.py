"""Connected components of a link table, by smallest label with pointer jumping.

Labels and links stay in tables; a round is a few joins whose result is written to the shared
folder, so that lost executors cost no more than a round. Stars take two rounds, chains a
number that grows with the logarithm of their length.
"""

from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                     .select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        heard = (both.join(labels, both["b"] == labels["node"])
                 .groupBy("a").agg(F.min("component").alias("heard")))
        told = (labels.join(heard, labels["node"] == heard["a"])
                .select("node", F.col("component").alias("old"),
                        F.least("component", "heard").alias("component")))
        told = written(told, "labels")
        jump = told.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = written(told.join(jump, told["component"] == jump["to"])
                      .select("node", "old", F.least("component", "next").alias("component")),
                      "labels")
        labels = new.drop("old")
        if new.where("old <> component").isEmpty():
            return labels
