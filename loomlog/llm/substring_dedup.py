"""Repeated passages: Rabin-Karp hashes of every window of ``length`` words, counted in Spark.

A window can only repeat if its anchor does: the smallest hash of its 16-word pieces, which two equal
windows share. A first pass writes each document's anchors (about one in eighteen words) and finds those
that two ids share; windows with another anchor are known to be single and are not sent anywhere. The
others form runs, the consecutive windows of one anchor. Equal runs are counted first: those of larger ids
than the smallest are removed whole. Only the windows of runs in their first id are then counted one by one, by a
96-bit hash, and joined with the first id that has them: the first id of a window is also the first id of
its run there. Per document the windows merge into maximal intervals to remove. Texts without a shared
anchor are not shuffled (as far as a filter of fixed size can tell), the others are, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, bit_filter, passes, slot, write_table
from .windows import WordHashes, mixed, rolling, sliding_min

LENGTH = 50
PIECE = 16


def anchors(hashes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The anchor of every window of ``length`` words; ``hashes`` are those of the words."""
    piece = min(PIECE, length)
    return sliding_min(rolling(hashes, piece), length - piece + 1)


def window_hashes(hashes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window: 64 bits, and 32 more from another base over re-mixed word hashes."""
    return rolling(hashes, length), (rolling(mixed(hashes, 0xA5A5), length, 1) >> np.uint64(32)).astype(np.int32)


def covered(starts: np.ndarray, counts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words are in ``counts`` consecutive windows from each of ``starts``, as intervals in a mask."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _own(spans: pa.ListScalar, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, n) of the spans (row, start, n) that belong to ``row``; null means none."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    start, n = (spans.values.field(x).to_numpy() for x in ("start", "n"))
    own = spans.values.field("row").to_numpy() == row
    return start[own], n[own]


def _result(ids: pa.Array, n_words: list[int], n_removed: list[int], kept: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    A word goes if a window of ``length`` words that covers it also starts in a row with a smaller id; windows are
    judged on the input. Null and empty texts have no words. Shorter texts have no window. Repeats within
    one id, repeated rows included, stay. Rows without an id are kept whole and make nothing else go.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                words = t.as_py().encode().split()
                if len(words) >= length:
                    found.append(np.unique(anchors(known.of(words), length)))
                    at.append(np.full(len(found[-1]), i))
            if found:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), batch.column(0).take(pa.array(np.concatenate(at)))], ["anchor", "doc_id"])

    posted = base.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(find_anchors, f"anchor long, doc_id {kind}")
    posted = write_table(posted, "anchors")
    shared = posted.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    wanted = posted.join(write_table(shared, "shared-anchors"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    wanted = write_table(wanted, "wanted")
    field = spark.sparkContext.broadcast(bit_filter(wanted, "doc_id"))
    told = base.withColumn("slot", slot("doc_id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(passes(field.value, batch.column(3).to_numpy())))
            packed = pa.array([squeeze.compress(t.as_py().encode()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "row", "packed"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~passes(field.value, batch.column(3).to_numpy())))
            words = [t.as_py().encode().split() for t in batch.column(2)]
            kept = pa.array([b" ".join(w).decode() for w in words], pa.string())
            yield _result(batch.column(0), list(map(len, words)), [0] * len(words), kept)

    packed = told.mapInArrow(pack, f"doc_id {kind}, row long, packed binary").repartition("doc_id")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            at, first, digests, sizes = [], [], [], []
            for i, (p, a) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                words = known.of(open_.decompress(p.as_py()).split())
                every = anchors(words, length)
                starts = np.flatnonzero(np.isin(every, a.values.to_numpy().view(np.uint64)))
                if not len(starts):
                    continue
                h, c = (x[starts] for x in window_hashes(words, length))
                begin = np.append(0, np.flatnonzero((np.diff(starts) != 1) | (np.diff(every[starts]) != 0)) + 1)
                size = np.diff(np.append(begin, len(starts)))
                digests += [xxhash.xxh3_128_digest(h[b : b + n].tobytes() + c[b : b + n].tobytes()) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
                at.append(np.full(len(begin), i))
                first.append(starts[begin])
                sizes.append(size)
            if at:
                place, digest = pa.array(np.concatenate(at)), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1)] + [batch.column(k).take(place) for k in (0, 1)]
                columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (first, sizes)]
                yield pa.RecordBatch.from_arrays(columns, ["r1", "r2", "doc_id", "row", "start", "n"])

    runs = packed.join(wanted, "doc_id").select("doc_id", "row", "packed", "anchors")
    runs = write_table(runs.mapInArrow(find_runs, f"r1 long, r2 long, doc_id {kind}, row long, start int, n int"), "runs")
    firsts = write_table(runs.groupBy("r1", "r2").agg(F.min("doc_id").alias("first")), "first-runs")
    placed = runs.join(firsts, ["r1", "r2"])
    span = F.struct("row", "start", "n")
    placed = placed.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("doc_id") > F.col("first"), span)).alias("later"), F.collect_set(F.when(F.col("doc_id") == F.col("first"), span)).alias("lead")
    )
    placed = write_table(placed, "placed-runs")

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            at, first, hs, cs = [], [], [], []
            for i, (row, p, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                start, n = _own(s, row)
                if len(start):
                    h, c = window_hashes(known.of(open_.decompress(p.as_py()).split()), length)
                    first.append(np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()))
                    at.append(np.full(len(first[-1]), i))
                    hs.append(h[first[-1]])
                    cs.append(c[first[-1]])
            if at:
                place = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(hs)), pa.array(np.concatenate(cs)), batch.column(0).take(place), batch.column(1).take(place), pa.array(np.concatenate(first).astype(np.int32))],
                    ["h", "c", "doc_id", "row", "start"],
                )

    single = packed.join(placed.filter(F.size("lead") > 0), "doc_id").select("doc_id", "row", "packed", "lead")
    single = single.mapInArrow(find_windows, f"h long, c int, doc_id {kind}, row long, start int")
    single = write_table(single, "windows")
    # Written before it is joined, so that Spark can split the rows of a hot window over several tasks.
    first = single.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = write_table(first.filter("first < last").drop("last"), "first-windows")
    apart = single.join(first, ["h", "c"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("row", "start", F.lit(1).alias("n"))).alias("apart"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for row, p, *cuts in zip(batch.column(1).to_pylist(), *(batch.column(k) for k in (2, 3, 4)), strict=True):
                words = open_.decompress(p.as_py()).split()
                n_words.append(len(words))
                start, n = map(np.concatenate, zip(*(_own(s, row) for s in cuts), strict=True))
                if len(start):
                    words = [w for w, g in zip(words, covered(start, n, len(words), length).tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield _result(batch.column(0), n_words, n_removed, pa.array(kept, pa.string()))

    schema = f"doc_id {kind}, n_words long, n_removed long, kept string"
    cut = packed.join(placed.select("doc_id", "later"), "doc_id", "left").join(apart, "doc_id", "left")
    return cut.select("doc_id", "row", "packed", "later", "apart").mapInArrow(remove, schema).unionByName(told.mapInArrow(keep, schema))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS low FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT x.doc_id, x.i FROM x JOIN f USING (h) WHERE x.doc_id > f.low),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
      CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_where(range(1, len(w) + 1), list_transform(range(1, len(w) + 1), lambda q: NOT list_contains(gone, q))))) END AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
