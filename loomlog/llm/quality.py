"""Quality rules: statistics of each text, hard base rules, and isolation forests over the statistics.

The statistics of all documents are computed once and written. The forests grow on all distinct texts labelled good and all
labelled junk, level by level: a pass over the table gives the ranges and counts of every tree's open nodes. Rows are
weighted, so that a tree is as deep as one of TREE_ROWS rows and a fixed small part of the weight is junk, however common
or copied it is in the corpus. Thresholds are calibrated on all labelled rows, and every document is scored with them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, write_table

#: Rows that all rows of a tree weigh together, and trees of a forest.
TREE_ROWS = 256
TREES = 100
#: One part in so many of a tree's weight is junk.
JUNK = 32
#: Rows of a task that counts a level's nodes, and the most tasks.
LEVEL_ROWS = 16_384
LEVEL_TASKS = 64
#: Scores are rounded to this part of one before they are compared, so the table of all scores of labelled rows is small.
GRADES = 2**16
#: Part of the rows labelled good that each forest's calibrated threshold must keep, see FEATURES.
KEEP_GOOD = (0.99, 0.999)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_marked")
#: What the forests split on, one forest each: what the text is written with, and how long and how repetitive it is. In one
#: forest splits on the latter, which good texts vary in most, would hide the former.
FEATURES = (("word_length", "symbols", "upper", "marked"), ("log_words", "dup_lines", "repeat_words"))
_ASCII_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in ``words``, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, last = Counter(windows), 0, -1
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 2 - max(last, i - 1)
            last = i + 2
    return covered


def statistics(text: str) -> tuple[int, ...]:
    """The values named in BASE and EXTRA."""
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space
    squeezed = b"".join(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.encode().strip(_ASCII_SPACE):
            dup += line in seen
            seen.add(line)
    without = lambda chars: len(squeezed) - len(squeezed.translate(None, chars))
    marked = sum(w[-1] in _SYMBOLS or w[-1] == 33 for w in words)
    return len(words), len(squeezed.decode()), without(_SYMBOLS), dup, repeated_words(words), without(_UPPER), marked


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text) and the statistics, one row per row of ``docs``."""
    arrow_limits(docs.sparkSession)
    names = BASE + EXTRA

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in columns)], ["doc_id", "row", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    return chosen.mapInArrow(task, f"doc_id {kind}, row long, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns named in FEATURES, forest by forest; rows as in BASE + EXTRA."""
    s = stats.astype(np.float64)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return np.column_stack([s[:, 1] / words, s[:, 2] / chars, s[:, 5] / chars, s[:, 6] / words]), np.column_stack([np.log(words), s[:, 3] / words, s[:, 4] / words])


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows; n may be a weight."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.clip(n - 1, 0.0, 1.0))


@dataclass(frozen=True)
class Nodes:
    """Nodes of one level, in order of tree and node: numbers of good and junk rows, least and largest feature values."""

    tree: np.ndarray
    node: np.ndarray
    good: np.ndarray
    junk: np.ndarray
    low: np.ndarray
    high: np.ndarray


def nodes_of(feature: np.ndarray, cut: np.ndarray, depth: int, x: np.ndarray, junk: np.ndarray) -> Nodes:
    """The nodes of level ``depth`` that rows ``x`` reach in trees that are grown up to it."""
    found = [[np.zeros(0, np.int64)] * 4 + [np.zeros((0, x.shape[1]))] * 2]
    for t in range(len(feature) if len(x) else 0):
        node, every = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(depth):
            at = feature[t, node]
            every, node, at = every[at >= 0], node[at >= 0], at[at >= 0]
            node = 2 * node + (x[every, at] >= cut[t, node])
        if not len(node):
            continue
        order = np.argsort(node.astype(np.int32), kind="stable")
        node, every = node[order], every[order]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        bad, rows = np.add.reduceat(junk[every].astype(np.int64), starts), np.diff(np.append(starts, len(node)))
        values = x[every]
        found.append([np.full(len(starts), t), node[starts], rows - bad, bad, np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)])
    return Nodes(*(np.concatenate(c) for c in zip(*found, strict=True)))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat arrays of complete binary trees: split feature (-1 for a leaf), cut, path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    @classmethod
    def grown(cls, level: Callable[[np.ndarray, np.ndarray, int], Nodes], trees: int, sample: int, seed: int) -> IsolationForest:
        """Trees from the nodes of one level after another, ``level`` giving those of the trees so far.

        Good rows weigh ``sample`` together, or one each if there are fewer, but for one part in JUNK, which junk has.
        Nodes that weigh no more than all junk are not split further: many alike rows of little weight would take many splits.
        """
        rng, feature, cut = np.random.default_rng(seed), np.full((trees, 2), -1), np.zeros((trees, 2))
        nodes = level(feature, cut, 0)
        good, junk = (int(x[0]) if len(x) else 0 for x in (nodes.good, nodes.junk))
        part = min(junk, max(1, min(sample, good) // JUNK)) if good else 0
        size = min(sample, good + part)
        weight = (size - part) / max(good, 1), part / max(junk, 1)
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        wide = ((0, 0), (0, 2 ** (depth + 1) - 2))
        feature, cut, path = np.pad(feature, wide, constant_values=-1), np.pad(cut, wide), np.zeros((trees, 2 ** (depth + 1)))
        for d in range(depth + 1):
            rows = weight[0] * nodes.good + weight[1] * nodes.junk
            path[nodes.tree, nodes.node] = d + mean_path(rows)
            splits = np.flatnonzero((rows > max(1, part)) & (nodes.high > nodes.low).any(1)) if d < depth else ()
            for k in splits:
                f = int(rng.choice(np.flatnonzero(nodes.high[k] > nodes.low[k])))
                feature[nodes.tree[k], nodes.node[k]], cut[nodes.tree[k], nodes.node[k]] = f, rng.uniform(nodes.low[k, f], nodes.high[k, f])
                path[nodes.tree[k], 2 * nodes.node[k] : 2 * nodes.node[k] + 2] = d + 1  # of a child without rows
            if not len(splits):
                break
            nodes = level(feature, cut, d + 1)
        return cls(feature, cut, path, depth, float(max(mean_path(size), 1e-9)))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 7, junk: np.ndarray | None = None) -> IsolationForest:
        """Trees over all of ``x`` and of ``junk``."""
        rows = x if junk is None else np.concatenate([x, junk])
        is_junk = np.arange(len(rows)) >= len(x)
        return cls.grown(lambda feature, cut, d: nodes_of(feature, cut, d, rows, is_junk), trees, sample, seed)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / norm): towards 1 for rows that random splits isolate early."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for f, c, p in zip(self.feature, self.cut, self.path, strict=True):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = f[node]
                node = np.where(at < 0, node, 2 * node + (x[every, np.maximum(at, 0)] >= c[node]))
            total += p[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def grow(rows: DataFrame, seed: int) -> list[IsolationForest]:
    """A forest on each part of FEATURES over all ``rows``: the statistics and junk, a boolean."""
    names, width = BASE + EXTRA, max(map(len, FEATURES))
    tasks = min(LEVEL_TASKS, 1 + rows.count() // LEVEL_ROWS)
    dealt = write_table(rows.select(*names, "junk").repartition(tasks), "quality-grown")
    held = pa.schema([*((n, pa.int64()) for n in names), ("junk", pa.bool_())])
    least, most = [f"low{i}" for i in range(width)], [f"high{i}" for i in range(width)]
    keys, columns = ["tree", "node"], ["good", "junk", *least, *most]

    def level(part: int, feature: np.ndarray, cut: np.ndarray, depth: int) -> Nodes:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches, held)  # a few MB of numbers; one set of nodes a task, not one a batch
            x = features(np.column_stack([table.column(n).to_numpy() for n in names]))[part]
            found = nodes_of(feature, cut, depth, x, table.column("junk").to_numpy())
            ends = [np.pad(v, ((0, 0), (0, width - v.shape[1]))).T for v in (found.low, found.high)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found.tree, found.node, found.good, found.junk, *ends[0], *ends[1])], keys + columns)

        schema = ", ".join(f"{c} long" for c in (*keys, "good", "junk")) + ", " + ", ".join(f"{c} double" for c in least + most)
        merged = dealt.mapInArrow(task, schema).groupBy(*keys).agg(
            *(F.sum(c).alias(c) for c in ("good", "junk")), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most)
        )
        all_ = merged.toArrow().sort_by([(k, "ascending") for k in keys])  # at most 2 ** depth nodes a tree
        one = lambda c: all_.column(c).to_numpy()
        n = len(FEATURES[part])
        return Nodes(*map(one, (*keys, "good", "junk")), *(np.column_stack(list(map(one, c[:n]))) for c in (least, most)))

    return [IsolationForest.grown(lambda *now, part=k: level(part, *now), TREES, TREE_ROWS, seed) for k in range(len(FEATURES))]


def best_cut(values: np.ndarray, good: np.ndarray, junk: np.ndarray, keep_good: float) -> float:
    """Scores over this are rejected: the best balanced accuracy among cuts that keep ``keep_good`` of the good rows.

    ``good`` and ``junk`` are the numbers of rows of each of the ascending scores.
    """
    if not good.sum():
        return float("inf")
    fine, bad = np.cumsum(good), np.cumsum(junk)
    first = np.searchsorted(fine, int(np.ceil(keep_good * (fine[-1] - 1))) + 1)
    gain = (bad[-1] - bad) / max(bad[-1], 1) + fine / fine[-1]
    return float(values[first + np.argmax(gain[first:])])


def threshold(forest: IsolationForest, rows: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """``best_cut`` of the scores of ``rows``."""
    values, at = np.unique(forest.score(rows), return_inverse=True)
    return best_cut(values, *(np.bincount(at[g], minlength=len(values)) for g in (good, ~good)), keep_good)


def grades(forests: list[IsolationForest], stats: np.ndarray) -> np.ndarray:
    """Scores of rows in parts of GRADES, forest by forest."""
    return np.stack([np.round(f.score(x) * GRADES).astype(np.int64) for f, x in zip(forests, features(stats), strict=True)])


def limits(forests: list[IsolationForest], labelled: DataFrame) -> list[float]:
    """The cut of each forest, in parts of GRADES, from the scores of all labelled rows."""
    names = BASE + EXTRA

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = grades(forests, np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]))
            for k, s in enumerate(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s), batch.column("quality_")], ["forest", "grade", "quality_"])

    counted = labelled.select(*names, "quality_").mapInArrow(task, "forest long, grade long, quality_ int").groupBy("forest", "grade").agg(
        F.count_if(F.col("quality_") == 1).alias("good"), F.count_if(F.col("quality_") == 0).alias("junk")
    )
    table = counted.toArrow().sort_by([("forest", "ascending"), ("grade", "ascending")])  # at most GRADES rows a forest
    forest, *rest = (table.column(c).to_numpy() for c in ("forest", "grade", "good", "junk"))
    return [best_cut(*(c[forest == k] for c in rest), keep) for k, keep in enumerate(KEEP_GOOD)]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, the BASE statistics, base_failed, kept, anomaly (the larger score of the two forests), row (a hash of the text).

    Null and empty texts have no words and fail the base rules. Rows are judged one by one: repeated rows
    and ties get equal verdicts. Without usable labels nothing but the base rules rejects. Labels are rows
    (doc_id, quality), 1 for good; null labels are ignored. Other columns are ignored. Without a row labelled good
    the forests grow on distinct texts of all rows. A row is kept if no forest scores it over its threshold.
    """
    stats = write_table(with_statistics(docs, id_col, text_col), "quality-stats")
    names = BASE + EXTRA
    passed = stats.filter(~base_failed())
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality_")).filter("quality_ IN (0, 1)").distinct()
    labelled = write_table(passed.join(known, "doc_id"), "quality-labelled")
    texts = labelled.select("row", *names, (F.col("quality_") == 0).alias("junk")).distinct()
    forests = grow(texts if labelled.filter("quality_ = 1").head(1) else passed.select("row", *names, F.lit(False).alias("junk")).distinct(), seed)
    cuts = limits(forests, labelled)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            known = [batch.column(c) for c in ("doc_id", *BASE, "base_failed")]
            scores = grades(forests, x)
            odd = (scores > np.array(cuts)[:, None]).any(0)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            verdict = [pa.array(~failed & ~odd), pa.array(scores.max(0) / GRADES), batch.column("row")]
            yield pa.RecordBatch.from_arrays([*known, *verdict], ["doc_id", *BASE, "base_failed", "kept", "anomaly", "row"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, anomaly double, row long"
    return stats.withColumn("base_failed", base_failed()).mapInArrow(task, schema)
