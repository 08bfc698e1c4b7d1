import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from loomlog.llm import jaccard_join as jj


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def brute(rows, words, percent):
    sets, up = sets_of(rows, words), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, words=4, percent=85):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_links int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df, words, percent).collect()), key=str)


@pytest.mark.parametrize(("length", "seed"), [(60, 1), (260, 2)])
def test_equals_brute_force_with_frequent_shingles(spark, monkeypatch, length, seed):
    monkeypatch.setattr(jj, "FREQUENT", 3)
    monkeypatch.setattr(jj, "STAR", 4)
    monkeypatch.setattr(jj, "CROWD", 12)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rng.choices(vocabulary, k=length) for _ in range(5)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base)) if rng.random() < 0.8 else rng.choices(vocabulary, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, length // 20)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            words = words[: rng.randint(0, 5)]
        rows.append((i, "\t".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (3, rows[9][1]), (3, rows[3][1]), (None, rows[4][1]), (None, "lonely words only here"), (505, "É b c d"), (506, "é b c d")]
    assert run(spark, rows) == brute(rows, 4, 85)


def test_five_words_and_empty_table(spark):
    rows = [(1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m x"), (3, "a b c d")]
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80) == [(1, 10, 1), (2, 10, 1), (3, 1, 3)]
    assert run(spark, []) == []


def test_very_long_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 50_000)
    base = [f"w{i}" for i in range(40_000)]
    near = [" ".join(base[:k] + ["x"] + base[k:]) for k in (5, 20_000, 39_999)]
    rows = [(9, " ".join(base)), *enumerate(near), (20, " ".join(base[:30_000])), (21, " ".join(f"v{i}" for i in range(70_000))), (22, near[0].upper())]
    assert run(spark, rows) == brute(rows, 4, 85)


def test_packed_entries_come_back(monkeypatch):
    rng = np.random.default_rng(2)
    for top in (2**15, 2**40):
        keys, ids = rng.integers(0, 2**48, 500), np.sort(rng.integers(0, top, 500))
        sizes, spots, marks = rng.integers(0, 2**18, 500), rng.integers(0, 60_000, 500), rng.integers(0, 2**48, 9)
        rows = list(jj.packed(7, keys, ids, sizes, spots, marks))
        assert len({r[0] for r in rows}) == len(rows) <= 7
        k, i, n, s, m = (np.concatenate(x) for x in zip(*(jj.unpacked(*r[1:]) for r in rows)))
        assert sorted(zip(k, i, n, s)) == sorted(zip(keys, ids, sizes, spots)) and sorted(m) == sorted(marks)


def test_prefixes_share_a_key_whenever_sets_are_similar():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(2, 700))
        shared = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = int(n * 0.17 * rng.random())
        one = np.unique(np.concatenate([shared, rng.integers(0, 2**63, extra).astype(np.uint64)]))
        two = np.unique(shared[: n - int((0.15 * n - extra) * rng.random())]) if extra < 0.15 * n else np.unique(shared)
        if 100 * len(np.intersect1d(one, two)) < 85 * len(np.union1d(one, two)) or min(len(one), len(two)) < 2:
            continue
        frequent = np.sort(jj.keys_of(np.unique(np.concatenate([one, two]))[: int(rng.integers(0, n + 1))])) if rng.random() < 0.5 else np.unique(jj.keys_of(np.concatenate([one, two])))
        a, b = (jj.postings(jj.keys_of(s), len(s), frequent, 85)[0] for s in (one, two))
        b = np.where((b < 0) & (b & 2 == 2), b ^ 1, b)  # the partners' keys
        assert len(np.intersect1d(a, b)) > 0


def test_token_classes_are_fewer_than_shared_shingles():
    for percent in (80, 85):
        for n in range(2, 400):
            for m in range(max(2, -(-percent * n // 100)), n + 1):
                o = -(-percent * (n + m) // (100 + percent))
                ends = [jj.prefix_length(x, percent) - x + o for x in (n, m)]
                shared = max(min(ends), min(jj.needed(x, percent)[1] for x in (n, m)))
                assert jj.token_classes(jj.band(m), jj.band(n), percent) < shared


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base, rows = [rng.choices(vocabulary, k=240) for _ in range(3)], []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return [*rows, (3, rows[9][1]), (200, rows[5][1].upper()), (201, ""), (202, None), (203, "lonely words")]


@pytest.mark.parametrize("low", [False, True])
def test_all_links_of_near_copies_are_found(spark, monkeypatch, low):
    if low:
        for name, value in (("FREQUENT", 3), ("STAR", 4), ("CROWD", 12)):
            monkeypatch.setattr(jj, name, value)
    rows = near_copies(3)
    sets = sets_of(rows, 4)
    classes = list({frozenset(s) for s in sets if s})
    near = lambda a, b: a != b and 100 * len(a & b) >= 85 * len(a | b)
    count = {c: sum(near(c, d) for d in classes) for c in classes}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out, links = jj.Join(df, 4, 85, "doc_id", "text").run()
    want = sorted(((d, count.get(frozenset(s), 0)) for (d, _), s in zip(rows, sets, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_links) for r in out.collect()), key=str) == want
    pairs = [(r.u, r.v) for r in links.collect()]
    assert len(set(pairs)) == len(pairs) == sum(count.values()) // 2 > 300
    few = jj.jaccard_components(df, every=False)
    assert few.columns == ["doc_id", "n_shingles", "component_id"]
    key = lambda t: sorted(map(str, t.select("doc_id", "n_shingles", "component_id").collect()))
    assert key(few) == key(out)


def test_a_common_first_line_makes_no_candidates(spark, monkeypatch):
    """Short documents that share nothing but a line of 15 words, of sizes as far apart as similar ones may be."""
    edges, original = [], jj.components
    monkeypatch.setattr(jj, "FREQUENT", 8)
    monkeypatch.setattr(jj, "components", lambda e: edges.append(e.count()) or original(e))
    rng = random.Random(6)
    line = " ".join(f"h{i}" for i in range(15))
    rows = [(i, line + "\n" + " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 90)))) for i in range(600)]
    out = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert edges[0] == 0 and all(r.component_id == r.doc_id and r.n_links == 0 for r in out)
