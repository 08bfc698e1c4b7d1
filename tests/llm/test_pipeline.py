"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import random

import numpy as np
import pytest
from test_jaccard_join import brute as jaccard_brute
from test_line_dedup import brute as line_brute
from test_mixing import brute_targets

import corpus_pipeline
from loomlog.llm import quality
from loomlog.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]
    line = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared = [line(12) for _ in range(3)]
    rows = []
    for i in range(160):
        lines = [line(rng.randint(20, 40)) for _ in range(rng.randint(3, 6))]
        if i % 5 == 0:
            lines[1:1] = shared
        rows.append((i, "\n".join(lines)))
    for i in range(0, 40, 4):  # near copies on one line, so that line dedup leaves them
        words = rows[i][1].split()
        words[3] = "changed"
        rows += [(200 + i, " ".join(rows[i][1].split())), (300 + i, " ".join(words))]
    rows += [(400 + i, " ".join(w + "$%*" for w in vocabulary[i : i + 80])) for i in range(12)]
    rows += [(500, None), (501, ""), (502, "short text"), (0, rows[0][1]), (None, line(90))]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(d, t, "en", ["a", "b", "a", None][i % 4], len(t or "")) for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(not 400 <= d < 412), 0) for d, _ in rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").distinct().write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_stage_equals_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS and docs.filter("n_chars <> length(text)").isEmpty()
        rows = [(r.doc_id, r.text) for r in before]
        if name == "quality_rules":
            verdict = quality.quality(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
            assert docs.count() == verdict.filter("kept").count() and not docs.filter("doc_id >= 500").count()
            assert docs.filter("doc_id < 400").count() >= 0.98 * sum(1 for d, _ in rows if d is not None and d < 400)
        elif name == "line_dedup":
            unique = sorted({(d, t) for d, t in rows if d is not None})
            kept = {(d, t) for d, t, n, cut in line_brute(unique, 2) if cut == 0 or cut < n}
            assert set(pairs(docs)) - {x for x in pairs(docs) if x[0] is None} == kept
        elif name == "jaccard_join":
            least = {d for d, _, c in jaccard_brute(rows, 5, 80) if d == c}
            assert pairs(docs) == sorted({(d, t) for d, t in rows if d in least}, key=str)
            assert not docs.filter("doc_id >= 200 AND doc_id < 400").filter("doc_id % 100 % 4 = 0").filter("doc_id >= 300").count()
        elif name == "mixing":
            sizes, taken = {}, {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
            for r in docs.collect():
                taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
            assert all(abs(taken[s] - t) <= 1 for s, t in brute_targets(sizes).items())
        else:
            lib = tokenizers.Tokenizer.from_file(tokenizer_path())
            want = sorted((str(d), lib.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
            assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in docs.collect()) == want


def empty(spark, tables, columns="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_columns(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = stage(spark, empty(spark, tables), tables).columns
    assert stage(spark, empty(spark, tables), tables).collect() == []
    words = [" ".join(f"word{i * 7 + k}" for k in range(60)) for i in range(3)]
    rows = [(1, words[0], "en", "a", 0, 5, "x", 1), (1, words[0], "en", "a", 0, 5, "x", 1), (2, words[1], None, None, None, None, None, None), (None, words[2], "en", "a", 1, 1, "y", 2), (3, None, None, "b", 0, 0, "z", 3), (4, "", "en", "b", 0, 0, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, spans string, copies int")
    out = stage(spark, docs, tables)
    assert out.columns == columns
    ids = [r.doc_id for r in out.collect()]
    assert {1, 2} <= set(ids)
    if name == "jaccard_join":
        assert sorted(ids, key=str) == [1, 2, 3, 4, None]
    if name == "bpe":
        assert len(ids) == len(rows)


def test_survivors_of_null_and_repeated_ids(spark, tables):
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (0, 118, 119)]
    far = [" ".join(f"z{i}" for i in range(80)), " ".join(f"z{i}" for i in range(81))]
    rows = [(7, near[0]), (5, near[1]), (5, near[2]), (None, " ".join(base)), (None, far[0]), (None, far[1]), (None, far[1]), (9, ""), (9, ""), (10, None)]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, tables).collect()]
    assert sorted(map(str, (d for d, _ in got))) == ["10", "5", "9", "None"]
    assert {t for d, t in got if d == 5} < set(near) and {t for d, t in got if d is None} < set(far)


def test_run_ends_with_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 100
