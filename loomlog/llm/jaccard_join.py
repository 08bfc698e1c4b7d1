"""N-gram Jaccard self-join with token-combination prefixes.

Documents of equal shingle sets form a class. The shingles of a set are ordered by hash. Two sets of sizes n and m that reach
the similarity share o(n) = ceil(percent * n / 100) shingles or more, so their extended prefixes of n - o(n) + k(n) and
m - o(m) + k(m) share at least k = min(k(n), k(m)), two or more; how many exactly depends on both sizes. A shingle in at most
FREQUENT prefixes is rare and a key by itself. For the case that all shared ones are frequent, the frequent ones of a prefix
are dealt by hash into token classes, fewer than shared ones: two shared ones fall into the same one, so a class is indexed
under the pairs within each of them. The pairs are made for each band of partner sizes, and their keys name both bands; a
prefix with fewer frequent shingles than are shared needs none.

Prefixes go to the buckets of their keys as packed arrays, and a bucket is counted by itself: keys of one class end there,
classes that meet in a rare key become a pair if sizes and positions allow the similarity, pairs are counted, and those
with too few shared keys go. Classes that meet in a pair key are connected to one of them only. A shingle that is frequent already
in what one task has read is sent as one mark, so no key fills a bucket. The components of what is left are read as whole texts and compared
in blocks of bounded size, each text once for every block of its component. So the links are all there are, but no pair is
ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, bit_filter, filter_cells, passes, slot, write_table
from .components import components
from .windows import WordHashes, mixed, rolling

#: Shingles that similar sets share at least in their extended prefixes, if they have as many in common: more than a line has that
#: many documents begin with, so such a line alone does not make candidates of them.
SHARED = 24
#: Shingles in more prefixes are frequent.
FREQUENT = 32
#: In a block, shingles of more classes are counted by a matrix product, others pair by pair.
STAR = 64
#: Most classes and shingles of a block. Both bound its memory, neither changes a result.
CROWD = 1024
BLOCK_SHINGLES = 2**18
#: Entries that a task packs at a time, and the mean number of them in a bucket.
PACKED = 2**20
BUCKET = 2**17
#: Pair keys that a frequent entry makes, about.
COMBINED = 8
#: Ratio of the sizes at the ends of a band.
BAND = 1.04
#: Bits of a shingle's hash, from the top, that a key has.
KEY_BITS = 48


def shingles(text: str, known: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; a shorter text is one shingle, an empty one none."""
    found = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if len(found) >= words:
        return np.unique(rolling(known.of(found), words))
    return mixed(rolling(known.of(found), len(found)), 0x51ED + len(found)) if found else np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a, b = mixed(s, 0x1234567).sum(dtype=np.uint64), mixed(s, 0x89ABCDEF).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def needed(n: int, percent: int) -> tuple[int, int]:
    """(o, k): shingles that a similar set shares at least, and those of them in both extended prefixes."""
    o = -(-percent * n // 100)
    return o, min(o, max(SHARED, -(-3 * n // 100)))


def prefix_length(n: int, percent: int) -> int:
    o, k = needed(n, percent)
    return n - o + k


def band(n: int) -> int:
    """The band of a set size."""
    return int(math.log(n) / math.log(BAND) + 1e-9)


@lru_cache(maxsize=100_000)
def token_classes(x: int, y: int, percent: int) -> int:
    """One less than what similar sets of sizes in bands x and y share at least in their extended prefixes.

    The prefix that ends first lies before the other's end, so all of it but the shingles of its set that are not shared
    is in the other one. The bound grows with the other's size, but for roundings, and with the own one up to SHARED shingles;
    beyond, it falls with that. So it is least at an end of each band.
    """
    def ends(b: int) -> tuple[int, int]:
        low, high = int(BAND**b) - 1, int(BAND ** (b + 1)) + 2
        inside = [n for n in (*range(max(2, low), low + 4), *range(max(2, high - 4), high + 1)) if band(n) == b]
        return min(inside, default=2), max(inside, default=2)

    def least(n: int, m: int) -> int:
        return prefix_length(n, percent) - n - (-percent * (n + m) // (100 + percent))

    (low_x, high_x), (low_y, high_y) = ends(x), ends(y)
    always = min(needed(low_x, percent)[1], needed(low_y, percent)[1])
    return max(2, always, min(*(least(n, low_y) for n in (low_x, high_x)), *(least(m, low_x) for m in (low_y, high_y))) - 3) - 1


def keys_of(s: np.ndarray) -> np.ndarray:
    """Keys of shingles, in the same order and not negative."""
    return (s >> np.uint64(64 - KEY_BITS)).view(np.int64)


def head(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the extended prefix; none for a set of one shingle, which is similar to no other."""
    return keys_of(s[: prefix_length(len(s), percent)]) if len(s) > 1 else np.zeros(0, dtype=np.int64)


def among(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``frequent``."""
    if not len(frequent):
        return np.zeros(len(keys), dtype=bool)
    return frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys


def pairs_within(keys: np.ndarray, classes: int, tag: int) -> np.ndarray:
    """Combined key of every pair of keys in the same one of so many token classes."""
    groups = mixed(keys.view(np.uint64), 0xC0B0) % np.uint64(classes)
    order = np.argsort(groups, kind="stable")
    size = np.unique(groups, return_counts=True)[1]
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(keys)) - 1  # later members of the same class
    one = np.repeat(np.arange(len(keys)), rest)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(rest) - rest, rest)
    one, two = order[one], order[two]
    return keys_of(mixed(mixed(keys[one].view(np.uint64), 0xC0B1 + tag) ^ keys[two].view(np.uint64), 0xC0B2))


def combinations(often: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Pair keys of the frequent keys (in order) of the extended prefix of a set of size n, for every band of partners."""
    own, made = band(n), [np.zeros(0, dtype=np.int64)]
    for other in range(band(max(2, -(-percent * n // 100))), band(100 * n // percent) + 1):
        x, y = min(own, other), max(own, other)
        classes = token_classes(x, y, percent)
        if len(often) > classes:  # else one of the shared ones is rare
            made.append(pairs_within(often, classes, x << 20 | y << 4))
    return np.concatenate(made)


def postings(keys: np.ndarray, n: int, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(index keys, frequent shingles) of the extended prefix of a set with these keys; keys of pairs are negative."""
    keys = keys[: prefix_length(n, percent)]
    often = among(keys, frequent)
    return np.concatenate([keys[~often], -4 * (1 + combinations(keys[often], n, percent))]), int(often.sum())


def shared_least(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """What similar sets of sizes n and m share at least in their extended prefixes."""
    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = (percent * x + 99) // 100
        k = np.minimum(o, np.maximum(SHARED, (3 * x + 99) // 100))
        return k, k - o

    (k, i), (l, j) = of(n), of(m)
    both = (percent * (n + m) + 99 + percent) // (100 + percent)
    return np.maximum(np.minimum(i, j) + both, np.minimum(k, l))


#: Packed entries of a bucket: 6 bytes a key, differences of the ascending class ids in 2 (larger ones in ``jumps``), sizes and positions in 2 or 4.
PACK = "bucket long, first long, keys binary, ids binary, jumps binary, sizes binary, spots binary, marks binary"


def six(keys: np.ndarray) -> bytes:
    """Keys of 48 bits in six bytes each."""
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def narrow(x: np.ndarray) -> bytes:
    return x.astype("<u2" if not len(x) or x.max() < 2**16 else "<u4").tobytes()


def widen(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * count else "<u4").astype(np.int64)


def packed(buckets: int, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, spots: np.ndarray, marks: np.ndarray) -> Iterator[tuple]:
    """Rows of PACK. Entries in any order, marks are keys."""
    place = mixed(keys.view(np.uint64), 0xB0CC) % np.uint64(buckets)
    order = np.lexsort((ids, place))
    place, keys, ids, sizes, spots = (x[order] for x in (place, keys, ids, sizes, spots))
    at = mixed(marks.view(np.uint64), 0xB0CC) % np.uint64(buckets)
    order = np.argsort(at)
    at, marks = at[order], marks[order]
    for b in np.unique(np.concatenate([place, at])):
        i, j = np.searchsorted(place, [b, b + np.uint64(1)])
        k, m = np.searchsorted(at, [b, b + np.uint64(1)])
        first = ids[i] if i < j else 0
        steps = np.diff(ids[i:j], prepend=first)
        far = np.flatnonzero(steps >= 2**16)
        jumps = np.stack([far, steps[far]], axis=1).astype("<i8").tobytes()
        steps[far] = 0
        yield int(b), int(first), six(keys[i:j]), steps.astype("<u2").tobytes(), jumps, narrow(sizes[i:j]), narrow(spots[i:j]), six(marks[k:m])


def unpacked(first: int, keys: bytes, ids: bytes, jumps: bytes, sizes: bytes, spots: bytes, marks: bytes) -> tuple[np.ndarray, ...]:
    """(keys, ids, sizes, positions, marks) of a row."""
    steps = np.frombuffer(ids, "<u2").astype(np.int64)
    far = np.frombuffer(jumps, "<i8").reshape(-1, 2)
    steps[far[:, 0]] = far[:, 1]
    n = len(steps)
    return from_six(keys), first + np.cumsum(steps), widen(sizes, n), widen(spots, n), from_six(marks)


def grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of the columns ``names``, rows) of every group of sorted batches, one group at a time in memory."""
    now, parts = None, []
    for batch in batches:
        codes = np.zeros(batch.num_rows, dtype=bool)
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        for x in columns:
            codes[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(codes).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            key = tuple(int(x[i]) for x in columns)
            if key != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                now, parts = key, []
            parts.append(batch.slice(i, j - i))
    if parts:
        yield now, pa.Table.from_batches(parts)


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, counts) of the groups of equal keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
    return order, starts, np.diff(np.append(starts, len(s)))


def within(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places) of all pairs in adjacent groups of so many members, one distance after another."""
    ends = np.repeat(np.cumsum(counts), counts)
    here = np.arange(len(ends))
    for step in range(1, int(counts.max(initial=0))):
        here = here[here + step < ends[here]]
        yield here, here + step


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each of n places under the edges (u, v)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def connected(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, smallest id of their component) where ids that have a key in common are connected."""
    names, at = np.unique(ids, return_inverse=True)
    order, starts, counts = by_key(keys)
    at = at[order]
    return names, names[labels(len(names), at, np.repeat(at[starts], counts))]


def meetings(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, i: np.ndarray, marks: np.ndarray, limit: int, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of one bucket: pairs (u, v, least shared, times met in rare keys), u > v, and entries (id, key, n) of frequent keys."""
    order, starts, counts = by_key(keys)
    often = (counts > limit) | among(keys[order][starts], np.unique(marks))
    hot = order[np.repeat(often, counts)]
    rare = order[np.repeat(~often & (counts > 1), counts)]
    u, v, need = [], [], []
    for x, y in within(counts[~often & (counts > 1)]):
        x, y = rare[x], rare[y]
        most = np.minimum(i[x], i[y]) + np.minimum(n[x] - i[x], n[y] - i[y])
        good = (100 * most >= percent * (n[x] + n[y] - most)) & (ids[x] != ids[y])
        x, y = x[good], y[good]
        u.append(np.maximum(ids[x], ids[y]))
        v.append(np.minimum(ids[x], ids[y]))
        need.append(shared_least(n[x], n[y], percent))
    u, v, need = (np.concatenate([np.zeros(0, dtype=np.int64), *z]) for z in (u, v, need))
    order = np.lexsort((v, u))
    u, v, need = u[order], v[order], need[order]
    new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, dtype=np.int64)
    return [u[new], v[new], need[new], np.diff(np.append(new, len(u)))], [ids[hot], keys[hot], n[hot]]


def overlaps(sets: list[np.ndarray], limit: int) -> np.ndarray:
    """Sizes of the intersections of a bounded number of sets; only what is above the diagonal counts."""
    size = len(sets)
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(size), list(map(len, sets)))
    order, _, counts = by_key(hashes)
    owner, dense = owner[order], counts > limit
    few = owner[np.repeat(~dense & (counts > 1), counts)]  # ascending within a group, as the sort is stable
    out = np.zeros(size * size, dtype=np.float32)
    for x, y in within(counts[~dense & (counts > 1)]):
        np.add.at(out, few[x] * size + few[y], 1)
    out = out.reshape(size, size)
    many, column, columns = owner[np.repeat(dense, counts)], np.repeat(np.arange(dense.sum()), counts[dense]), int(dense.sum())
    for low in range(0, columns, 2048):
        part, held = (column >= low) & (column < low + 2048), np.zeros((size, min(2048, columns - low)), dtype=np.float32)
        held[many[part], column[part] - low] = 1
        out += held @ held.T
    return out


def linked(sets: list[np.ndarray], left: np.ndarray | None, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v), u > v, of the similar pairs; with ``left`` only of pairs of which one is left."""
    n = np.array(list(map(len, sets)), dtype=np.int32)
    both = overlaps(sets, limit).astype(np.int32)
    v, u = np.nonzero(100 * both >= percent * (n[:, None] + n[None, :] - both))
    good = (v < u) if left is None else (v < u) & (left[u] != left[v])
    return u[good], v[good]


_NAMES = [x.split()[0] for x in PACK.split(", ")]
_KINDS = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in PACK.split(", ")])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of PACK as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS.types[k]) for k in range(len(_NAMES))], _NAMES)


def _joined(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _of_group(group: pa.Table) -> list[np.ndarray]:
    """(keys, ids, sizes, positions, marks) of all rows of a bucket."""
    return _joined([unpacked(*row) for row in zip(*(group.column(n).to_pylist() for n in _NAMES[1:]), strict=True)])


class Join:
    """The steps of one join over ``docs``; ``run`` gives its results."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> None:
        self.spark = docs.sparkSession
        arrow_limits(self.spark)
        self.words, self.percent, self.limit, self.dense, self.crowd = words, percent, FREQUENT, STAR, CROWD
        self.kind = docs.schema[id_col].dataType.simpleString()
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))

    def scan(self) -> DataFrame:
        """(row, doc_id, t, a, b, n, head) of every row: its number, the hash of its text, its set's signature, size and first keys."""
        words, percent = self.words, self.percent

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                sets = [shingles(t.as_py(), known, words) for t in batch.column(1)]
                signed = [signature(s) for s in sets]
                a, b = (pa.array([x[k] for x in signed], pa.int64()) for k in (0, 1))
                heads = pa.array([six(head(s, percent)) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), a, b, pa.array(list(map(len, sets)), pa.int64()), heads], ["doc_id", "t", "a", "b", "n", "head"])

        seen = self.base.mapInArrow(task, f"doc_id {self.kind}, t long, a long, b long, n long, head binary")
        return write_table(seen.select(F.monotonically_increasing_id().alias("row"), "*"), "jaccard-scan")

    def heads(self, seen: DataFrame, classes: DataFrame) -> DataFrame:
        """(id, n, head), one row per class of several shingles; id is the class's smallest row.

        Only rows that a filter of fixed size takes for members of a larger class are shuffled to drop repeats.
        """
        several = seen.filter("n > 1")
        cells = F.broadcast(filter_cells(classes.filter("c > 1"), "a"))  # at most FILTER_BITS / 64 rows
        told = several.withColumn("slot_", slot("a")).withColumn("cell", F.expr("int(slot_ div 64)")).join(cells, "cell", "left")
        told = told.withColumn("again", F.expr("coalesce(shiftright(bits, int(slot_ % 64)) & 1L, 0L) = 1L")).select("row", "a", "b", "n", "head", "again")
        once = told.filter("again").groupBy("a", "b", "n").agg(F.min("row").alias("row"), F.first("head").alias("head"))
        return told.filter("NOT again").select("row", "n", "head").unionByName(once.select("row", "n", "head")).withColumnRenamed("row", "id")

    def entered(self, heads: DataFrame, buckets: int) -> DataFrame:
        """The prefixes' entries as rows of PACK; those of keys that one task has found frequent are in buckets below 0."""
        limit = self.limit

        def rows(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            keys, ids, sizes, spots = _joined(found)
            order, starts, counts = by_key(keys)
            hot = np.zeros(len(keys), dtype=bool)
            hot[order] = np.repeat(counts > limit, counts)
            out = list(packed(buckets, keys[~hot], ids[~hot], sizes[~hot], spots[~hot], keys[order][starts[counts > limit]]))
            known = packed(1, keys[hot], ids[hot], sizes[hot], spots[hot], keys[:0])
            return batch_of(out + [(-1 - row[1] % buckets, *row[1:]) for row in known])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, held = [], 0
            for batch in batches:
                keys = [from_six(h.as_py()) for h in batch.column(2)]
                lengths = np.array(list(map(len, keys)), dtype=np.int64)
                spots = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                found.append((np.concatenate([np.zeros(0, np.int64), *keys]), *(np.repeat(batch.column(k).to_numpy(), lengths) for k in (0, 1)), spots))
                held += len(spots)
                if held >= PACKED:
                    yield rows(found)
                    found, held = [], 0
            if held:
                yield rows(found)

        return heads.select("id", "n", "head").mapInArrow(task, PACK)

    def met(self, heads: DataFrame, buckets: int) -> DataFrame:
        """Rows of two kinds. 0: classes x > y met w times in rare keys and must share z or more. 1: class x of size z has the frequent key y."""
        limit, percent, names = self.limit, self.percent, ["kind", "x", "y", "z", "w"]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket,), group in grouped(batches, ("bucket",)):
                keys, ids, sizes, spots, marks = _of_group(group)
                met, often = meetings(keys, ids, sizes, spots, marks, limit, percent) if bucket >= 0 else ([], [ids, keys, sizes])
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(met[0]), np.int32)), *map(pa.array, met)], names)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(often[0]), np.int32)), *map(pa.array, often), pa.array(np.ones(len(often[0]), np.int64))], names)

        dealt = self.entered(heads, buckets).repartition("bucket").sortWithinPartitions("bucket")
        return write_table(dealt.mapInArrow(task, "kind int, x long, y long, z long, w long"), "jaccard-met")

    def pairs(self, met: DataFrame) -> DataFrame:
        """(u, v): pairs whose shared rare keys, with as many frequent ones as both have at most, are enough."""
        pairs = met.filter("kind = 0").groupBy(F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("least")).agg(F.sum("w").alias("r"))
        often = met.filter("kind = 1").groupBy("x").agg(F.count(F.lit(1)).alias("f"))
        less = pairs.filter("r < least").join(often.withColumnRenamed("x", "u"), "u").withColumnRenamed("f", "g").join(often.withColumnRenamed("x", "v"), "v")
        return pairs.filter("r >= least").select("u", "v").unionByName(less.filter("r + least(f, g) >= least").select("u", "v"))

    def combined(self, met: DataFrame) -> DataFrame:
        """(u, v) that connect all classes with a pair key in common.

        A task connects its own classes first and sends one class for each key. A bucket gives an edge for each class in it at most,
        so there are only as many buckets as the entries need.
        """
        often = met.filter("kind = 1").select("x", "y", "z")
        percent, buckets = self.percent, 1 + COMBINED * often.count() // BUCKET

        def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, ids = _joined(found)
            names, roots = connected(keys, ids)
            keys, at = np.unique(keys, return_index=True)
            ids, zero = roots[np.searchsorted(names, ids[at])], np.zeros(len(keys), dtype=np.int64)
            own = names != roots
            edges = [(-1 - int(names[0]) % buckets, 0, *(x[own].astype("<i8").tobytes() for x in (names, roots)), *[b""] * 4)] if own.any() else []
            return batch_of([*packed(buckets, keys, ids, zero, zero, keys[:0]), *edges])

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, held = [], 0
            for (name, n), group in grouped(batches, ("x", "z")):
                keys = combinations(group.column("y").to_numpy(), n, percent)
                if len(keys):
                    found.append((keys, np.full(len(keys), name)))
                    held += len(keys)
                if held >= PACKED:
                    yield rows(found)
                    found, held = [], 0
            if held:
                yield rows(found)

        def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket,), group in grouped(batches, ("bucket",)):
                if bucket < 0:
                    u, v = (np.frombuffer(b"".join(group.column(k).to_pylist()), "<i8") for k in ("keys", "ids"))
                else:
                    u, v = connected(*_of_group(group)[:2])
                    u, v = u[u != v], v[u != v]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        often = often.repartition("x").sortWithinPartitions("x", "y")
        return often.mapInArrow(combine, PACK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(connect, "u long, v long")

    def blocks(self, classes: DataFrame, roots: DataFrame) -> DataFrame:
        """(root, i, j, id, mine, parts, packed): the compressed text of every class, for each pair of blocks that its own block is in.

        A component is dealt to ``parts`` blocks by hash; ``mine`` says whether the class is in block i.
        """
        members = classes.join(roots.withColumnRenamed("node", "id"), "id").select("id", "n", "root", F.col("rep.doc_id").alias("id_"), F.col("rep.t").alias("t_"))
        parts = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / self.crowd)).cast("long")
        members = write_table(members.join(members.groupBy("root").agg(parts.alias("parts")), "root"), "jaccard-members")
        field = self.spark.sparkContext.broadcast(bit_filter(members, "t_"))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                batch = batch.filter(pa.array(passes(field.value, batch.column(3).to_numpy())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([squeeze.compress(t.as_py().encode()) for t in batch.column(1)], pa.binary())], ["doc_id", "t", "packed"])

        texts = self.base.select("doc_id", "text", "t", slot("t").alias("slot")).mapInArrow(task, f"doc_id {self.kind}, t long, packed binary")
        found = texts.join(members, (F.col("t") == F.col("t_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
        own = F.pmod(F.xxhash64("id"), F.col("parts"))
        found = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        return found.select("root", i.alias("i"), j.alias("j"), "id", (F.col("own") == i).alias("mine"), "parts", "packed")

    def compared(self, blocks: DataFrame, every: bool) -> DataFrame:
        """(id, root, n_links, links, parts) of every class in a pair of blocks: the smallest class that links in it connect it to,
        its links in it, and (with ``every``) those to smaller classes."""
        words, percent, dense = self.words, self.percent, self.dense

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None  # repeated rows of one text are next to each other
            for batch in batches:
                names = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
                new = [x != y for x, y in zip(names, [last, *names], strict=False)]
                last = names[-1] if names else last
                yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, open_ = WordHashes(), zstandard.ZstdDecompressor()
            for (_, i, j), group in grouped(once(batches), ("root", "i", "j")):
                sets = [shingles(open_.decompress(p.as_py()).decode(), known, words) for p in group.column("packed")]
                ids = group.column("id").to_numpy()
                u, v = linked(sets, None if i == j else group.column("mine").to_numpy(), percent, dense)
                roots = ids[labels(len(ids), u, v)]
                counts = np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
                order = np.argsort(u, kind="stable")
                ends = np.append(0, np.cumsum(np.bincount(u, minlength=len(ids)))).astype(np.int32) if every else np.zeros(len(ids) + 1, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[v[order]] if every else ids[:0]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(counts.astype(np.int64)), lists, pa.array(group.column("parts").to_numpy())], ["id", "root", "n_links", "links", "parts"])

        dealt = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "id")
        return write_table(dealt.mapInArrow(task, "id long, root long, n_links long, links array<long>, parts long"), "jaccard-compared")

    def run(self, every: bool = True) -> tuple[DataFrame, DataFrame]:
        """(rows: doc_id, t, n_shingles, component_id, root, n_links), (links: u, v between class ids).

        t is the hash of a row's text and root its component's smallest class, null without shingles. Without ``every`` rows have
        no n_links, and the second table is empty.
        """
        seen = self.scan()
        classes = seen.filter("n > 0").groupBy("a", "b", "n").agg(
            F.min("doc_id").alias("doc_id"), F.min(F.struct("row", "doc_id", "t")).alias("rep"), F.count(F.lit(1)).alias("c")
        )
        classes = write_table(classes.withColumn("id", F.col("rep.row")), "jaccard-classes")
        entries = seen.agg(F.sum(F.octet_length("head")) / 6).first()[0] or 0
        buckets = max(1, int(entries) // BUCKET, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        met = self.met(self.heads(seen, classes), buckets)
        near = components(self.pairs(met).unionByName(self.combined(met)))
        compared = self.compared(self.blocks(classes, near), every)
        whole = compared.filter("parts = 1").select(F.col("id").alias("node"), "root")
        rest = components(compared.filter("parts > 1 AND id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
        counts = compared.groupBy("id").agg(F.sum("n_links").alias("n_links"))

        joined = classes.select("id", "a", "b", "n", "doc_id").join(whole.unionByName(rest).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        final = joined.join(least, "root").join(counts, "id", "left").select("a", "b", "n", "component_id", "root", "n_links")
        rows = seen.select("doc_id", "t", "a", "b", "n").join(write_table(final, "jaccard-final"), ["a", "b", "n"], "left")
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if every else []
        links = compared.select(F.col("id").alias("u"), F.explode("links").alias("v"))
        return rows.select("doc_id", "t", F.col("n").alias("n_shingles"), own.alias("component_id"), "root", *counted), links


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", every: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and with ``every`` n_links.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct ``words``-word shingles
    (A-Z lower-cased; a text with fewer words is one shingle). Null, empty and blank texts have none, link
    with nothing and are their own component. component_id is the smallest id reachable. n_links counts the links
    between the row's class and other classes. Repeated rows and equal sets are one class. Null ids are smallest never; a
    component of them has a null id. Other columns, whatever their names, are not read.
    """
    return Join(docs, words, percent, id_col, text_col).run(every)[0].drop("t", "root")
