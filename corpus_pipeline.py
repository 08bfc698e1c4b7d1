"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing sources, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import bpe, jaccard_join, line_dedup, mixing, quality
from loomlog.llm.common import release, table, told, write_table, written
from loomlog.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_KINDS = {"doc_id": T.LongType(), "n_chars": T.LongType()}


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to date; columns that are missing become null, others go."""
    low = {c.lower(): c for c in docs.columns}
    kind = lambda c: _KINDS.get(c, T.StringType())
    out = docs.select(*[(F.col(low[c]) if c in low else F.lit(None).cast(kind(c))).alias(c) for c in COLUMNS])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest. Rows of one doc_id are judged by their own texts.

    Null and empty texts fail the base rules and go. Repeated rows all stay or all go; null ids are ids like any other.
    """
    docs = _documents(docs)
    verdict = quality.quality(docs, table(spark, sf_dir, "labels")).filter("NOT kept")
    gone = write_table(verdict.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct(), "rejected")
    # Only rows that a filter of fixed size takes for rejected ones are shuffled.
    docs = told(docs, "doc_id", gone, "__id", "__told")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__row"))
    kept = docs.filter("__told").join(gone, same, "left_anti").unionByName(docs.filter("NOT __told"))
    return kept.select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; those of which nothing is left go.

    Texts without lines (null, empty, blank) stay as they are. Rows without an id are not changed; repeated rows are no repeats of
    each other.
    """
    out = line_dedup.line_dedup(_documents(docs))
    return _documents(out.filter("n_deleted = 0 OR n_deleted < n_lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (five-word shingles, similarity 0.8).

    It is the one of the smallest doc_id, of several texts of that id the one of the smallest hash; ids that are null come last.
    Documents without words are linked with nothing and all stay. Rows that repeat both doc_id and text become one.
    """
    docs = _documents(docs)
    rows = jaccard_join.Join(docs, 5, 80, "doc_id", "text").run(False)[0]
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("least")).select("least.doc_id", "least.t")
    stay = least.unionByName(rows.filter("root IS NULL").select("doc_id", "t")).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__t"))
    return docs.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, the last one of a source cut to the words taken.

    Null sources are one source; documents without words are never drawn. Repeated rows count each, and each can be drawn twice.
    """
    docs = _documents(docs)
    return _documents(mixing.take(docs, write_table(mixing.mix(docs), "mix")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the digests of ids and decoded text of every row.

    A null text counts as empty and has no ids. Repeated rows give equal rows, each of them.
    """
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: The forest's verdicts, the permuted draw and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents one after another.

    Columns of documents that are missing are null, others do not take part. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        first = written()
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, first, written() - 1)  # what the stage wrote on its way
    return docs
