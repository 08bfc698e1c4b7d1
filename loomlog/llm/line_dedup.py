"""Repeated runs of lines, found by winnowing over line hashes. DataFrame functions only.

A document is its sequence of non-blank lines (compared without outer white space). Every run of ``window``
consecutive line hashes has a minimum; the positions of the minima are selected and posted with their hash, so two
documents that share a run of that length share a posted fingerprint in it. Postings of fingerprints that occur once are
dropped by a join with the repeated ones; the others are anchors. Around each anchor the match is extended both ways: all
runs of ``window`` lines for which the anchor is the minimum are compared, by a 128-bit hash of their content, with the
first position of that content in the corpus. What occurs earlier (in a smaller doc_id, or further up in
the same document) is deleted; overlapping and adjacent runs join into longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import told, write_table

#: Lines that a repeated run has at least. A shorter document is one run as a whole.
WINDOW = 2

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column) -> Column:
    """Hashes of the non-blank lines, in order."""
    trimmed = F.filter(F.transform(_lines(text), lambda x: F.regexp_replace(x, _TRIM, "")), lambda x: x != "")
    return F.transform(trimmed, lambda x: F.xxhash64(x))


def _postings(h: Column, window: int) -> Column:
    """(fp, at, runs) of each selected position: a line hash that is the (rightmost) minimum of ``window`` lines around it.

    ``runs`` extend the position both ways: (start, a, b) of all runs of ``window`` lines whose minimum it is, a and b hashing
    their content.
    """
    size = F.least(F.size(h), F.lit(window))
    last = F.size(h) - size
    least = lambda part: F.size(part) - F.array_position(F.reverse(part), F.array_min(part)).cast("int")
    places = F.transform(F.sequence(F.lit(0), last), lambda i: i + least(F.slice(h, i + 1, size)))

    def run(i: Column) -> Column:
        part = F.slice(h, i + 1, size)
        return F.struct(i.alias("start"), F.xxhash64(F.lit(1), part).alias("a"), F.xxhash64(F.lit(2), size, part).alias("b"))

    def posted(p: Column) -> Column:  # p: the place of each run's minimum
        def posting(at: Column) -> Column:
            around = F.sequence(F.greatest(F.lit(0), at - size + 1), F.least(at, last))
            return F.struct(F.element_at(h, at + 1).alias("fp"), at.alias("at"), F.transform(F.filter(around, lambda i: F.element_at(p, i + 1) == at), run).alias("runs"))

        return F.transform(F.array_distinct(p), posting)

    return F.when(F.size(h) > 0, F.flatten(F.transform(F.array(places), posted))).otherwise(F.array())  # places are found once


def repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, cut): for each row with deletions the 0-based positions of its deleted non-blank lines.

    ``row`` is a hash of the text that, with doc_id, tells rows of one doc_id apart.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), _hashes(F.col(text_col)).alias("h")
    )
    posted = rows.select("doc_id", "row", F.size("h").alias("n"), F.explode(_postings(F.col("h"), window)).alias("w"))
    posted = write_table(posted.select("doc_id", "row", "n", "w.*"), "line-postings")
    place = F.struct("doc_id", "row", "at")
    anchors = posted.groupBy("fp").agg(F.min(place).alias("p"), F.max(place).alias("q"))
    # The aggregates are written before they are joined, so that Spark can split the rows of a hot line over several tasks.
    shared = write_table(anchors.filter("p <> q").select("fp"), "line-anchors")
    near = posted.join(shared, "fp").select("doc_id", "row", "n", F.explode("runs").alias("r")).select("doc_id", "row", "n", "r.*")
    near = write_table(near, "line-runs")
    first = near.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("c"))
    first = write_table(first.filter("c > 1").drop("c"), "line-firsts")
    later = near.join(first, ["a", "b"]).filter(
        (F.col("doc_id") > F.col("first.doc_id")) | ((F.col("row") == F.col("first.row")) & (F.col("start") > F.col("first.start")))
    )
    return later.groupBy("doc_id", "row").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.least(F.col("start") + window, F.col("n")) - 1)))).alias("cut")
    )


def line_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs deleted from the text, and the columns n_lines and n_deleted (non-blank lines).

    All columns and rows stay; a text may become empty. Null texts stay null and rows without an id are never
    changed. Of rows with the same id and text none is a later occurrence of another; of rows with the same
    id but other texts neither. Columns of ``docs`` that are called n_lines or n_deleted are replaced.
    Blank lines stay, unless every line of the text is deleted.
    """
    cuts = repeated_lines(docs, window, id_col, text_col).select(
        F.col("doc_id").alias("__ll_id"), F.col("row").alias("__ll_row"), F.col("cut").alias("__ll_cut")
    )
    # Only rows that a filter of fixed size takes for rows with deletions are shuffled.
    cuts = write_table(cuts, "line-cuts")
    keyed = told(docs, id_col, cuts, "__ll_id", "__ll_told")
    mine = keyed.filter("__ll_told").withColumn("__ll_key", F.xxhash64(F.col(text_col)))
    mine = mine.join(cuts, (F.col(id_col) == F.col("__ll_id")) & (F.col("__ll_key") == F.col("__ll_row")), "left")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    joined = mine.select(*names, "__ll_cut").unionByName(keyed.filter("NOT __ll_told").select(*names, F.lit(None).cast("array<int>").alias("__ll_cut")))
    lines = _lines(F.col(text_col))
    solid = F.transform(lines, lambda x: F.regexp_replace(x, _TRIM, "") != "")
    n_lines = F.size(F.filter(solid, lambda x: x)).cast("long")
    cut = F.coalesce(F.size("__ll_cut"), F.lit(0)).cast("long")
    # Positions of the lines in the text whose rank among the non-blank lines is cut.
    places = F.filter(F.transform(solid, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    gone = F.transform(F.col("__ll_cut"), lambda r: F.element_at(F.col("__ll_places"), r + 1))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.element_at(lines, i + 1)), "\n")
    new = F.when(F.col("__ll_cut").isNull(), F.col(text_col)).when(n_lines == cut, F.lit("")).otherwise(kept)
    out = joined.withColumn("__ll_places", F.when(F.col("__ll_cut").isNotNull(), places))
    return out.select(*[(new.alias(c) if c == text_col else F.col(c)) for c in names], n_lines.alias("n_lines"), cut.alias("n_deleted"))


ORACLE = """
WITH l AS (SELECT doc_id, u.line, u.i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
           unnest(ls) WITH ORDINALITY AS u(line, i)),
n AS (SELECT doc_id, line, i, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t FROM l),
s AS (SELECT doc_id, i, t, row_number() OVER w AS r, lead(t) OVER w AS t2, count(*) OVER (PARTITION BY doc_id) AS c
      FROM n WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT *, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, r) AS k FROM s WHERE t2 IS NOT NULL OR c = 1),
x AS (SELECT doc_id, r FROM v WHERE k > 1 UNION SELECT doc_id, r + 1 FROM v WHERE k > 1 AND t2 IS NOT NULL),
g AS (SELECT s.doc_id, s.i FROM s JOIN x USING (doc_id, r)),
m AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_deleted FROM g GROUP BY doc_id),
o AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i
      WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       sha256(CASE WHEN n_deleted = n_lines THEN '' ELSE coalesce(o.kept, '') END) AS text_sha256
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN o USING (doc_id)
"""
