"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id each node of ``edges`` (a, b) reaches.

    Rounds of taking the neighbours' smallest label and jumping to that label's own
    label, until no label changes. Labels are written to the shared folder each round,
    so lineage stays short; only a count of changes reaches the driver. Skewed joins
    are left to adaptive execution, and sums are combined before the shuffle.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("comp")), "labels")
    kind = labels.schema["comp"].dataType
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.lit(None).cast(kind).alias("own"), "comp")
        known = near.unionByName(labels.select("id", F.col("comp").alias("own"), "comp"))
        moved = known.groupBy("id").agg(F.max("own").alias("comp"), F.min("comp").alias("to"))
        jumped = moved.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("far")), "to").select("id", "comp", F.least("to", "far").alias("new"))
        after = stored(jumped, "labels")
        changed = after.where("new <> comp").limit(1).count()
        labels = after.select("id", F.col("new").alias("comp"))
        if not changed:
            return labels
