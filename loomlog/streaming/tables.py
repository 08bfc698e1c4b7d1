"""Small state tables with a version for every epoch, for functions of ``foreachBatch``.

A run of an epoch reads the last version before it and writes its own, so an epoch that is run again starts from the same
state and leaves the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def versions(spark: SparkSession, path: str) -> list[int]:
    """The epochs of a table, in order, on any file system that Spark reads. Half-written versions do not count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = (x.getPath() for x in fs.listStatus(root))
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[6:]) for p in found if p.getName().startswith("epoch=") and fs.exists(done(p, "_SUCCESS")))


def before(spark: SparkSession, path: str, epoch: int | None, schema: str) -> DataFrame:
    """The last version before an epoch (or the last of all); empty if there is none."""
    known = [e for e in versions(spark, path) if epoch is None or e < epoch]
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/epoch={known[-1]}")


def put(df: DataFrame, path: str, epoch: int) -> DataFrame:
    """Writes the version of an epoch and reads it again."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/epoch={epoch}")
