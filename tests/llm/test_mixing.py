from collections import defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from loomlog.llm import mixing as m


def brute_targets(sizes, share=1.5, limit=2, weights=(5, 2, 1)):
    """Reshare the excess of full sources by weight until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(limit * sizes[s] for s in full)
        target = {s: limit * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > limit * sizes[s]}
        if not over:
            return target
        full |= over


def docs(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), ["b", "a", "hot", "hot", "hot", "é", None][i % 7]) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "void"), (1002, " \n", None), (None, "x y z", "a"), (7, rows[7][1], "b"), (7, rows[7][1], "b"), (1003, "long " * 30_000, "one")]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, taken int").repartition(5)


def test_targets_quotas_and_limits(spark):
    df = docs(spark)
    out = m.mix(df, shards=5).collect()
    assert len(out) == df.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    shard_words = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == sum(c.words for c in r.copies) <= 2 * r.size and all(0 < c.words <= r.size for c in r.copies)
        for c in r.copies:
            shard_words[c.shard] += c.words
    assert {r.source: r.source_size for r in out} == sizes
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert set(shard_words) <= set(range(5))


def test_reruns_and_repartitions_agree(spark):
    key = lambda d: sorted(map(str, m.mix(d).collect()))
    assert key(docs(spark)) == key(docs(spark).repartition(2, "text"))


def test_take_cuts_to_the_words_taken(spark):
    df = docs(spark)
    mixed = m.mix(df)
    words = m.take(df, mixed).select(m.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert m.take(df, mixed).columns == ["doc_id", "text", "source", "taken", "shard_", "place_"]
    assert words == mixed.agg(F.sum("taken")).first()[0]


def test_repeated_rows_are_taken_as_often_as_the_mix_says(spark):
    """Equal rows of one id, some of which the cut leaves out: together they give the words of the mix, none more than twice its size."""
    text = " ".join(["w"] * 50)
    for share in (0.3, 1.5):
        df = spark.createDataFrame([(1, text, "a")] * 400 + [(1, text, "b")] * 3 + [(None, text, None)] * 5 + [(2, None, "a"), (3, "x y", "a")], "doc_id long, text string, source string")
        mixed = m.mix(df, share=share).cache()
        out = m.take(df, mixed).withColumn("n", m.word_count(F.col("text")))
        want = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
        assert {r.source: r.t for r in out.groupBy("source").agg(F.sum("n").alias("t")).collect()} == {k: v for k, v in want.items() if v}
        assert len({str(r.copies) for r in mixed.filter("source = 'a' AND size = 50").collect()}) > 1 or share > 1
        mixed.unpersist()


def test_hypergeometric_draws_have_the_exact_distribution(spark):
    lit = lambda x: F.lit(x).cast("long")
    draws = spark.range(20_000).select(m.hypergeometric(lit(100), lit(30), lit(20), (F.col("id") + 0.5) / 20_000).alias("x"))
    got = {r.x: r["count"] for r in draws.groupBy("x").count().collect()}
    for x in range(21):
        assert abs(got.get(x, 0) - 20_000 * comb(30, x) * comb(70, 20 - x) / comb(100, 20)) <= 2
    edge = spark.range(1).select(*(m.hypergeometric(lit(a), lit(b), lit(c), F.lit(0.7)).alias(f"c{i}") for i, (a, b, c) in enumerate([(5, 0, 3), (5, 5, 3), (0, 0, 0), (9, 4, 9), (1, 1, 0)])))
    assert tuple(edge.first()) == (0, 3, 0, 4, 0)


def test_tree_splits_quotas_exactly(spark):
    quotas = {0: 1000, 1: 37, 2: 0, 3: 1}
    df = spark.createDataFrame(list(quotas.items()), "rank int, quota long")
    rows = m.split_quotas(df, 6).collect()
    for k, q in quotas.items():
        assert sum(r.quota for r in rows if r["rank"] == k) == q
    totals = [sum(r.quota for r in rows if r.shard == s) for s in range(6)]
    assert max(totals) - min(totals) <= 3 and all(r.quota >= 0 for r in rows)


def test_empty_table_and_native_plan(spark, monkeypatch):
    assert m.mix(docs(spark).limit(0)).collect() == []
    plans, write = [], m.write_table
    told = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(m, "write_table", lambda x, name: plans.append(told(x)) or write(x, name))
    plans.append(told(m.mix(docs(spark))))
    assert len(plans) == 4 and not any("Python" in p or "Arrow" in p for p in plans)
