import random
from collections import defaultdict

from loomlog.llm.substring_dedup import substring_dedup


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    first = defaultdict(list)
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - length + 1):
            if d is not None:
                first[tuple(w[i : i + length])].append(d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and min(first[tuple(w[i : i + length])]) < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows, length):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string")
    return sorted((tuple(r) for r in substring_dedup(df, length).collect()), key=str)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(4)
    pieces = [" ".join(rng.choices("abcdefg", k=rng.randint(8, 40))) for _ in range(12)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choice("hijk") for _ in range(rng.randint(0, 9)))
        rows.append((rng.randint(0, 60), text.replace(" ", "\n", rng.randint(0, 2))))
    rows += [(None, pieces[0]), (None, pieces[0]), (7, None), (8, ""), (61, rows[0][1]), (61, rows[0][1])]
    for length in (6, 20):
        assert run(spark, rows, length) == brute(rows, length)


def test_run_repeated_inside_its_first_document(spark):
    a = [f"a{i}" for i in range(30)]
    rows = [(1, " ".join(a[:25])), (2, " ".join(["x", *a, "y", *a, "x"])), (2, " ".join(["z", *a]))]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[100:400], "y", *words[59_000:], "z"])), (3, " ".join(words[::-1])), (4, " ".join(words))]
    got = {d: (n, removed, kept) for d, n, removed, kept in run(spark, rows, 50)}
    assert [got[d][:2] for d in (1, 2, 3, 4)] == [(60_000, 0), (1303, 1300), (60_000, 0), (60_000, 60_000)] and got[2][2] == "x y z" and got[4][2] == ""


def test_empty_table(spark):
    assert run(spark, [], 50) == []
