"""Exact duplicates by a heavy-hitter split.

Digests of the normalised texts go through Misra-Gries summaries (one per task, merged by sum); the at
most ``k`` merged candidates are counted exactly and, as a table of bounded size, broadcast: their rows
are settled map-side, however many copies there are. All other digests have at most N / (k + 1) copies
and take the ordinary shuffle: their groups are counted with partial sums and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, write_table

#: Counters of a Misra-Gries summary; the broadcast table has no more rows (about 60 bytes each).
K = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def shrink(counters: dict[bytes, int], k: int) -> dict[bytes, int]:
    """Reduce to at most k counters by subtracting the (k + 1)-th largest value."""
    if len(counters) <= k:
        return counters
    cut = sorted(counters.values(), reverse=True)[k]
    return {d: c - cut for d, c in counters.items() if c > cut}


def misra_gries(digests: DataFrame, column: str, k: int = K) -> DataFrame:
    """(digest, estimate) of at most k candidates; holds every digest of frequency over N / (k + 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                counters[x["values"]] = counters.get(x["values"], 0) + x["counts"]
            counters = shrink(counters, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["digest", "estimate"]
        )

    parts = digests.select(F.col(column).alias("digest")).mapInArrow(task, "digest binary, estimate long")
    merged = parts.groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.desc("estimate"), "digest").limit(k)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts form a group like any other. Rows that repeat both id and text
    count each in group_size, and one of them stays. Null ids never win against others; a group of null
    ids only keeps one of its rows. Other columns are ignored. An empty table gives an empty result.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest")
    )
    base = write_table(base, "digests")
    candidates = F.broadcast(misra_gries(base, "digest", k).select("digest"))
    group = (F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = base.join(candidates, "digest", "left_semi").groupBy("digest").agg(*group)
    winners = write_table(verified.filter("group_size > 1"), "winners")

    light = base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Counted with partial sums and read again, so that rows of one digest need not meet in one task.
    groups = write_table(light.groupBy("digest").agg(*group), "digest-groups")
    joined = base.join(F.broadcast(winners), "digest").unionByName(light.join(groups, "digest"))
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Rows of the smallest id: one, but for repeated rows and groups of null ids.
    keepers = joined.filter(is_keeper)
    several = keepers.filter("group_size > 1").withColumn("kept", F.row_number().over(W.partitionBy("digest").orderBy("doc_id")) == 1)
    out = several.unionByName(keepers.filter("group_size = 1").withColumn("kept", F.lit(True))).unionByName(joined.filter(~is_keeper).withColumn("kept", F.lit(False)))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
      row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept FROM d)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
