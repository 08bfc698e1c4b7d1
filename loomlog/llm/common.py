"""Helpers shared by the corpus operators: shared-folder tables, inputs, Arrow limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator contract: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[str, str] | None] = []
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the session runs on a single machine (tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if sc.applicationId not in _own_dirs:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs a re-run of the tasks that read the table, not of what made it.
    ``release`` removes the tables of a session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomlog/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``write_table`` has made so far."""
    return len(_written)


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Delete the tables that ``write_table`` made in this session, or those numbered from ``first`` to before ``last``; returns how many."""
    jvm, sc = spark._jvm, spark.sparkContext
    mine = [x for x in _written[first:last] if x and x[0] == sc.applicationId]
    for x in mine:
        path = jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _written[_written.index(x)] = None
    return len(mine)


def arrow_limits(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Bound what one Arrow batch holds, in rows and bytes, so that long texts do not fill a Python worker.

    A lower number of rows that the user has set stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def smallest_hashed(df: DataFrame, column: str, limit: int, salt: int) -> DataFrame:
    """The ``limit`` rows of the smallest hashed ``column`` (then by all columns), found without a sort of the table.

    Rows far above the limit-th hash are filtered out first, so that tasks send few rows to the driver.
    """
    n, bits = df.count(), 2**40
    h = F.pmod(F.xxhash64(F.lit(salt), column), F.lit(bits))
    share = min(1.0, (limit + 6 * limit**0.5 + 100) / max(n, 1))
    return df.filter(h < int(share * bits)).orderBy(h, *df.columns).limit(limit)


#: Bits of a filter on ids. A full one keeps nothing out and so only stops helping.
FILTER_BITS = 2**24


def slot(column: str) -> Column:
    """The bit of a value in a ``bit_filter``."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def filter_cells(values: DataFrame, column: str) -> DataFrame:
    """(cell, bits): a filter of fixed size over hashed values, at most FILTER_BITS / 64 rows."""
    return values.select(slot(column).alias("s")).groupBy(F.expr("int(s div 64)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, int(s % 64)))").alias("bits"))


def told(df: DataFrame, column: str, values: DataFrame, of: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether a row's value may be among ``values``. False is certain, true is not."""
    cells = F.broadcast(filter_cells(values, of).withColumnsRenamed({"cell": "__ll_cell", "bits": "__ll_bits"}))  # at most FILTER_BITS / 64 rows
    out = df.withColumn("__ll_slot", slot(column)).withColumn("__ll_cell", F.expr("int(__ll_slot div 64)")).join(cells, "__ll_cell", "left")
    return out.withColumn(name, F.expr("coalesce(shiftright(__ll_bits, int(__ll_slot % 64)) & 1L, 0L) = 1L")).drop("__ll_slot", "__ll_cell", "__ll_bits")


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """``filter_cells`` as an array, to keep rows without a partner out of a shuffle."""
    field = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for cell, bits in filter_cells(values, column).collect():
        field[cell] = bits
    return field


def passes(field: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set; a row outside the filtered values may pass, no row inside fails."""
    return (field[slots // 64] >> (slots % 64)) & 1 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or a variant of it that no (case-insensitive) column of ``taken`` uses."""
    low, name = {c.lower() for c in taken}, wanted
    while name.lower() in low:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null and blank texts. JVM only."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}", "")
    parts = F.split(t, SPACE, -1)
    return F.when(t == "", F.lit(0)).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")
