import hashlib
import random
import re
from collections import defaultdict

from loomlog.llm import exact_dedup as ed


def brute(rows):
    groups = defaultdict(list)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    for d, t in rows:
        groups[digest(t)].append(d)
    out = []
    for h, ids in groups.items():
        known = sorted(d for d in ids if d is not None)
        keep = known[0] if known else None
        kept = [keep is not None and d == keep and ids.index(d) == i or keep is None and i == 0 for i, d in enumerate(ids)]
        out += [(d, keep, len(ids), k, h) for d, k in zip(ids, kept, strict=True)]
    return sorted(out, key=str)


def run(spark, rows, k):
    df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, kept boolean")
    return sorted((tuple(r) for r in ed.exact_duplicates(df, k=k).collect()), key=str)


def test_equals_brute_force_with_hot_groups(spark):
    rng = random.Random(2)
    texts = ["hot  text", "hot\ttext", "warm", "", None, " ", "x" * 200_000, "nul\x00", "\x1c", "é\xa0é"] + [f"t{i}" for i in range(40)]
    rows = [(rng.randint(0, 300), rng.choices(texts, [60, 60, 30] + [3] * 47)[0]) for _ in range(700)]
    rows += [(5, "dup"), (5, "dup"), (None, "dup"), (None, "only null"), (None, "only null"), (None, "hot text")]
    for k in (2, 1024):
        assert run(spark, rows, k) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], 4) == []


def test_misra_gries_keeps_every_frequent_digest(spark):
    rng = random.Random(3)
    values = [b"a"] * 300 + [b"b"] * 150 + [bytes([rng.randrange(256), rng.randrange(256)]) for _ in range(550)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "d binary").repartition(7)
    found = {bytes(r.digest): r.estimate for r in ed.misra_gries(df, "d", 9).collect()}
    assert len(found) <= 9 and found[b"a"] >= 200 and b"b" in found
    assert ed.shrink({b"a": 5, b"b": 2, b"c": 1}, 1) == {b"a": 3}
