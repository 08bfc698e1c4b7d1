"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): each node hands its larger (or smaller) neighbours to its smallest one.

    The smallest neighbour is a running minimum, so neighbours are read in one pass, in order, and repeated edges do no harm.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = F.least(F.min("v").over(W.partitionBy("u").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)), F.col("u"))
    told = both.withColumn("m", m)
    # A node of the small step also keeps its own edge to its smallest neighbour: the row in which that neighbour stands.
    child = F.col("v") if large else F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    moved = told.filter("v > u") if large else told
    return moved.select(child.alias("u"), F.col("m").alias("v")).filter("u <> v")


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges as a table, and what tells whether they have changed, taken while they are written."""
    seen = Observation(f"edges-{uuid.uuid4().hex}")
    counted = edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    now = write_table(counted, "edges")
    return now, tuple(seen.get.values())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the component's smallest node.

    Takes about log(nodes) rounds; each is written to the shared folder. Loops and repeated edges do not matter.
    """
    now, state = _write(edges.select("u", "v").filter("u <> v"))
    while state[0]:
        before = state
        now, state = _write(_stars(_stars(now, True), False))
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
