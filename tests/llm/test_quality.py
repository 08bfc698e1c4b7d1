import random
import re
from collections import Counter

import numpy as np

from loomlog.llm import quality as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "c\n", "\n", "é|", "#*", "\x1c", "\x85 ", "\xa0", "a b c ", "\t"]) for _ in range(rng.randint(0, 40)))
        assert q.statistics(text)[:5] == brute(text)
    assert q.statistics("")[:5] == (0, 0, 0, 0, 0)


def corpus(spark, n=400):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        chosen = rng.choices(words, k=rng.randint(60, 200))
        bad = i % 16 == 0  # rare and unlike each other: what a forest can isolate
        marks = ["".join(rng.choices("$%*#&", k=rng.randint(1, 5))) for _ in range(3)]
        rows.append((i, " ".join(w + rng.choice(marks) if bad else w for w in chosen), "x"))
        labels.append((i, int(not bad), 0))
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "few words", "x"), (n + 3, "a b c " * 100, "x"), (0, rows[0][1], "x"), (None, rows[1][1], "x")]
    labels += [(1, None, 0), (n + 50, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rejects_what_is_odd_and_keeps_the_rest(spark):
    docs, labels = corpus(spark)
    out = q.quality(docs, labels).collect()
    assert len(out) == docs.count()
    verdict = {r.doc_id: r for r in out}
    good = [i for i in range(400) if i % 16]
    assert sum(verdict[i].kept for i in good) >= 0.98 * len(good) and sum(verdict[i].kept for i in range(0, 400, 16)) <= 5
    assert all(verdict[i].base_failed and not verdict[i].kept for i in (400, 401, 402, 403)) and verdict[None].kept
    assert len({r.anomaly for r in out if r.doc_id == 0}) == 1


def test_without_labels_only_base_rules_reject_and_empty_tables_work(spark):
    docs, labels = corpus(spark, 40)
    out = q.quality(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in out)
    assert q.quality(docs.limit(0), labels).collect() == []


def test_isolation_forest_scores_outliers_higher():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    score = q.IsolationForest.fit(x).score(x)
    assert score.argmax() == 500 and 0 < score.min() and score.max() < 1
    assert q.IsolationForest.fit(np.zeros((0, 3))).score(np.zeros((2, 3))).shape == (2,)


def test_forest_scores_equal_a_walk_of_each_tree():
    """Path lengths and verdict threshold against a plain recursive walk, row by row."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3))
    forest = q.IsolationForest.fit(x, trees=20, sample=64, junk=rng.normal(5, 1, (10, 3)))

    def walk(tree, row, node=1):
        f = forest.feature[tree][node]
        return forest.path[tree][node] if f < 0 else walk(tree, row, 2 * node + int(row[f] >= forest.cut[tree][node]))

    want = [2 ** (-np.mean([walk(t, row) for t in range(20)]) / forest.norm) for row in x]
    assert np.allclose(forest.score(x), want)
    good = np.arange(300) % 10 > 0
    limit = q.threshold(forest, x, good, 0.9)
    kept = [w <= limit for w, g in zip(want, good) if g]
    assert np.mean(kept) >= 0.9 and any(np.isclose(limit, w) for w in want)


def test_repetition_counts_in_the_verdict(spark):
    """Good rows never repeat lines; junk ones differ from them in nothing else."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(400):
        lines = [" ".join(rng.sample(words, 8)) for _ in range(20)]
        if i % 16 == 0:
            lines = lines[:17] + [lines[0]] * 3
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 16 > 0)) for i in range(400)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in q.quality(docs, labels).collect()}
    assert sum(kept[i] for i in range(400) if i % 16) >= 370 and sum(kept[i] for i in range(0, 400, 16)) <= 3


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + "\n" + long), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in q.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert out[1].n_words == 200_000 and out[2].n_repeat_words == 400_000 and out[2].base_failed and not out[1].base_failed


def rejected(spark, junk, n=400):
    """Shares of good and junk rows that are rejected, ``junk`` giving the words' marks of junk rows and None for good ones."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    rows, copied = [], " ".join(w + "$%*" for w in words[:100])
    for i in range(n):
        chosen, mark = rng.choices(words, k=rng.randint(60, 200)), junk(i)
        rows.append((i, copied if mark == "copied" else " ".join(w + (mark or "") for w in chosen)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(junk(i) is None)) for i in range(n) if i % 4 < 2], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in q.quality(docs, labels).collect()}
    bad = [i for i in range(n) if junk(i)]
    good = [i for i in range(n) if not junk(i)]
    return sum(not kept[i] for i in good) / len(good), sum(not kept[i] for i in bad) / len(bad)


def test_common_and_copied_junk_is_rejected(spark):
    """An eighth of all rows alike, a third of them alike, a third of them copies of one text."""
    for junk in (lambda i: "$%*" if i % 8 == 0 else None, lambda i: "$%*" if i % 3 == 0 else None, lambda i: "copied" if i % 3 == 0 else None):
        good, bad = rejected(spark, junk)
        assert good <= 0.02 and bad >= 0.9


def test_forests_and_cuts_come_from_all_rows(spark, monkeypatch):
    """Tables dealt over many tasks give the forest and the cut of all rows at once, and every row widens its range."""
    monkeypatch.setattr(q, "LEVEL_ROWS", 500)
    rng = np.random.default_rng(9)
    n = 9000
    stats = np.column_stack([rng.integers(60, 300, n), rng.integers(300, 900, n), *(rng.integers(0, 9, n) for _ in range(5))])
    stats[-1, 1] = 10**7  # one row beyond all others
    junk = np.arange(n) % 9 == 0
    names = q.BASE + q.EXTRA
    rows = spark.createDataFrame([(*map(int, s), bool(j), int(not j)) for s, j in zip(stats, junk)], ", ".join(f"{c} long" for c in names) + ", junk boolean, quality_ int")
    forests = q.grow(rows, 7)
    for forest, x in zip(forests, q.features(stats)):
        want = q.IsolationForest.fit(x[~junk], junk=x[junk])
        assert all(np.array_equal(getattr(forest, a), getattr(want, a)) for a in ("feature", "cut", "path"))
    first = forests[0]
    tops = [first.cut[t][1] for t in range(q.TREES) if first.feature[t][1] == 0]
    assert max(tops) > 100  # beyond the other rows' word lengths
    got = q.limits(forests, rows)
    for k, (scores, keep) in enumerate(zip(q.grades(forests, stats), q.KEEP_GOOD)):
        least = np.quantile(scores[~junk], keep, method="higher")
        gain = {c: (scores[junk] > c).mean() + (scores[~junk] <= c).mean() for c in np.unique(scores[scores >= least])}
        assert np.isclose(gain[got[k]], max(gain.values()))
