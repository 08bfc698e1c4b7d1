import random
import zlib

import numpy as np
import pytest

from loomlog.llm import toxicity as tox


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = tox.Model({"a": 1, "b": 2, "c": 3})
    words = ["a", "b", "c", "dd", "eee"]
    ids, (tri, start) = model.word_ids(words), tox.trigrams(words)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    at, y = np.array([[1, 2, 3, 4, 5], [3, 3, 2, 0, 0]]), np.array([1.0, 0.0])
    _, grads = model.gradients(*model.inputs(ids, tri, start), at, y, ids, tri, start)
    for k, v in model.p.items():
        i = {"tri": (int(tri[0]), 3), "word": (1, 2)}.get(k) or tuple(rng.integers(0, s) for s in v.shape)
        old, loss = v[i], []
        for sign in (1, -1):
            v[i] = old + sign * 0.01
            loss.append(model.gradients(*model.inputs(ids, tri, start), at, y, ids, tri, start)[0])
        v[i] = old
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(grads[k][i], rel=2e-2, abs=2e-6), k


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = tox.windows(n)
        assert {i for s in starts for i in range(s, min(n, s + tox.WINDOW))} == set(range(n))
        assert all(b - a <= tox.STRIDE for a, b in zip(starts, starts[1:]))


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    words, bad = [f"w{i}" for i in range(300)], ["vile", "nasty"]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 200))
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows


def test_learns_rare_words_and_scores_whole_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (902, "w1 " * 3000 + "nasty", 0.0), (None, "w1 w2", 0.0), (1, "w5", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(2, 1, None)], "doc_id long, quality int, toxic int")
    out = tox.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    truth = {i: y for i, _, y in rows if i != 1}
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    by_id = {r.doc_id: r for r in out}
    assert by_id[902].predicted == 1 and by_id[900].score == by_id[901].score


def naive(model, text):
    """The score by the formulas, one window, one step and one word at a time."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, H = {k: v.astype(np.float64) for k, v in model.p.items()}, tox.HIDDEN
    words = [tox.core(w) for w in text.split()]

    def gates(word):
        tri, _ = tox.trigrams([word])
        e = p["word"][model.vocabulary.get(word, 0)] + p["tri"][tri].mean(0)
        return e @ p["wx"] + p["bx"]

    def run(xs, u):
        h, out = np.zeros(H), []
        for x in xs:
            y = h @ u
            z, r = sig(x[:H] + y[:H]), sig(x[H : 2 * H] + y[H : 2 * H])
            n = np.tanh(x[2 * H :] + r * y[2 * H :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    worst = -np.inf
    for start in tox.windows(len(words)):
        xs = [gates(w) for w in words[start : start + tox.WINDOW]]
        ahead = run([x[: 3 * H] for x in xs], p["uf"])
        back = run([x[3 * H :] for x in reversed(xs)], p["ub"])[::-1]
        h = np.array([np.concatenate(x) for x in zip(ahead, back)])
        a = np.exp((np.tanh(h @ p["wa"]) @ p["va"])[:, 0])
        pooled = (a / a.sum()) @ h
        worst = max(worst, float((pooled @ p["wo"] + p["bo"])[0]))
    return sig(worst if words else float(p["bo"][0]))


def test_scores_equal_a_naive_network():
    rows = corpus(80)
    model = tox.train([t for _, t, _ in rows], [y for *_, y in rows], epochs=2, least_steps=4)
    texts = [t for _, t, _ in rows[:20]] + ["", "one", "NASTY!! vile??", " ".join(f"w{i % 300}" for i in range(500))]
    assert np.allclose(tox.Scorer(model).score(texts), [naive(model, t) for t in texts], atol=1e-4)


def test_small_samples_are_trained_until_they_are_learned():
    rows = corpus(60)
    model = tox.train([t for _, t, _ in rows], [y for *_, y in rows])
    got = tox.Scorer(model).score([t for _, t, _ in rows]) >= 0.5
    assert np.mean(got == np.array([y for *_, y in rows], dtype=bool)) >= 0.95


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(tox, "TRAIN_CHARS", 50)
    docs = spark.createDataFrame([(i, "w " * i) for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    texts, _ = tox.sample(docs, labels)
    assert texts and max(map(len, texts)) <= 50


def test_degenerate_inputs(spark):
    model = tox.train([], [])
    assert tox.Scorer(model).score(["", "a b"]).shape == (2,)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert len(tox.toxicity(docs, labels).collect()) == 1 and tox.toxicity(docs.limit(0), labels).collect() == []


def test_small_word_cache_gives_the_same_scores(monkeypatch):
    rows = corpus(60)
    model = tox.train([t for _, t, _ in rows], [y for *_, y in rows], epochs=2, least_steps=0)
    texts = [t for _, t, _ in rows]
    want = tox.Scorer(model).score(texts)
    monkeypatch.setattr(tox, "WORDS_KEPT", 5)
    small = tox.Scorer(model)
    assert np.allclose(np.concatenate([small.score([t]) for t in texts]), want, atol=1e-5)
