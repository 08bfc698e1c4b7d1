import random

from loomlog.llm import line_dedup as module
from loomlog.llm.line_dedup import line_dedup

SPACE = " \t\n\r\x0b\x0c"


def brute(rows, window):
    """First places of all runs of lines in order of (doc_id, place); a run seen before is deleted."""
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(SPACE)]
        plain = [lines[i].strip(SPACE) for i in solid]
        w, cut = min(window, len(plain)), set()
        for s in range(len(plain) - w + 1 if plain else 0):
            run = tuple(plain[s : s + w])
            if run in seen:
                cut |= set(range(s, s + w))
            seen.setdefault(run, (d, s))
        gone = {solid[i] for i in cut}
        kept = "" if plain and len(cut) == len(plain) else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, kept if t is not None else None, len(plain), len(cut)))
    return sorted(out)


def run(spark, rows, window):
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, n_lines int")
    return sorted((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in line_dedup(df, window).collect())


def test_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "common", " common "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "alone"), (204, "alone"), (205, "x\n" * 3000)]
    for window in (2, 3):
        got, want = run(spark, rows, window), brute(rows, window)
        assert [(a, b or "", c, d) for a, b, c, d in got] == [(a, b or "", c, d) for a, b, c, d in want]


def test_columns_rows_and_odd_ids(spark):
    text = "a\nb\nc"
    df = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, text, "t"), (None, text, "u")], "doc_id long, text string, source string")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_deleted"]
    assert sorted((r.source, r.text) for r in out.collect()) == [("s", text), ("s", text), ("t", ""), ("u", text)]
    assert line_dedup(df.limit(0)).collect() == []


def test_no_python_on_the_main_path(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plans, write = [], module.write_table
    told = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(module, "write_table", lambda x, name: plans.append(told(x)) or write(x, name))
    plans.append(told(line_dedup(df)))
    assert len(plans) == 6 and not any("Python" in p or "Arrow" in p for p in plans)
