"""Toxicity by a bidirectional GRU with attention pooling over word and character inputs, in numpy.

A word's input is its embedding (or that of unknown words) plus the mean embedding of its byte trigrams. A
document is cut into overlapping windows, the last one ending with the text; its score is that of its worst
window. Training is multiple-instance: it picks every document's worst window, again and again, and learns from
those. It uses at most TRAIN_TOXIC and TRAIN_CLEAN labelled rows, collected by smallest hashed id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, smallest_hashed

WINDOW, STRIDE = 64, 32
HIDDEN, EMBED, ATTEND = 8, 16, 8
#: Bounds of the training sample and of the vocabulary; words of fewer training documents are unknown.
TRAIN_TOXIC, TRAIN_CLEAN = 900, 1500
#: Longer texts are not trained on, so a sample has some tens of megabytes at most; they are scored like any other.
TRAIN_CHARS = 20_000
VOCABULARY, MIN_DOCUMENTS = 8192, 4
TRIGRAMS = 8192
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.01, 1e-4
#: Small samples are gone through more often, until so many steps are made; worst windows are picked EPOCHS times anyway.
LEAST_STEPS = 300
#: Labels are taken to be wrong this often, and a word's own embedding is left out this often.
NOISE, DROP = 0.03, 0.1
#: Words whose inputs a task keeps, and windows that it scores together.
WORDS_KEPT, WINDOWS = 150_000, 2048


#: What surrounds words most often; anything else goes the slow way.
_OUTER = ".,;:!?%$&*#|()[]\"'"


def core(word: str) -> str:
    """A word as the model sees it: lower case, without outer characters that are no letters or digits."""
    word = word.lower().strip(_OUTER) or word.lower()
    if word.isalnum():
        return word
    at = [i for i, c in enumerate(word) if c.isalnum()]
    return word[at[0] : at[-1] + 1] if at else word


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte trigrams of ^word$, start of each word's), one word after another."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [b"^" + w.encode() + b"$" for w in words]
    raw = [r if len(r) > 2 else b"^^$" for r in raw]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(size) - size
    h = (b[:-2] * 0x9E3779B1) ^ (b[1:-1] * 0x85EBCA6B) ^ (b[2:] * 0xC2B2AE35)
    h = ((h ^ (h >> 15)) * 0x2C1B3C6D >> 16) % TRIGRAMS
    inside = np.ones(len(b), dtype=bool)
    last = start + size - 1
    inside[last] = inside[last - 1] = False
    return h[inside[:-2]].astype(np.int64), start - 2 * np.arange(len(raw))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters and passes of the network. All arrays are float32."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": normal(0.1, len(vocabulary) + 1, EMBED), "tri": normal(0.1, TRIGRAMS, EMBED),
            "wx": normal(EMBED**-0.5, EMBED, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), "ub": normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN),
            "wa": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTEND), "va": normal(ATTEND**-0.5, ATTEND, 1),
            "wo": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, 1), "bo": np.array([-1.0], np.float32),
        }

    def word_ids(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)

    def inputs(self, ids: np.ndarray, tri: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedding, projection to all gates) of each word; row 0 is padding."""
        size = np.diff(np.append(start, len(tri)))[:, None]
        e = self.p["word"][ids] + np.add.reduceat(self.p["tri"][tri], start, axis=0) / size if len(ids) else np.zeros((0, EMBED), np.float32)
        e = np.concatenate([np.zeros((1, EMBED), np.float32), e]).astype(np.float32)
        return e, e @ self.p["wx"] + self.p["bx"]

    def _run(self, gates: np.ndarray, u: np.ndarray, at: np.ndarray, mask: np.ndarray | None, out: np.ndarray, order: Iterable[int], keep: list | None) -> None:
        h = np.zeros((len(at), HIDDEN), np.float32)
        for t in order:
            x, y = gates[at[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
            z, r, yn = zr[:, :HIDDEN], zr[:, HIDDEN:], y[:, 2 * HIDDEN :]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * yn)
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, yn))
            h = new
            out[:, t] = h

    def forward(self, gates: np.ndarray | list[np.ndarray], at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ``at`` holds rows of ``gates`` (or of its two halves), 0 for padding."""
        half = gates if isinstance(gates, list) else [np.ascontiguousarray(gates[:, : 3 * HIDDEN]), np.ascontiguousarray(gates[:, 3 * HIDDEN :])]
        mask = at > 0
        full = bool(mask.all())
        h = np.empty((*at.shape, 2 * HIDDEN), np.float32)
        steps: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
        n = range(at.shape[1])
        self._run(half[0], self.p["uf"], at, None if full else mask, h[:, :, :HIDDEN], n, steps[0])
        self._run(half[1], self.p["ub"], at, None if full else mask, h[:, :, HIDDEN:], reversed(n), steps[1])
        flat = h.reshape(-1, 2 * HIDDEN)
        a = np.tanh(flat @ self.p["wa"])
        s = (a @ self.p["va"]).reshape(at.shape)
        s = np.where(mask, s, -30.0)
        w = np.exp(s - s.max(1, keepdims=True)) * mask
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", w, h)
        if keep is not None:
            keep |= {"steps": steps, "h": h, "a": a, "w": w, "pooled": pooled, "mask": None if full else mask}
        return (pooled @ self.p["wo"])[:, 0] + self.p["bo"][0]

    def _back(self, steps: list, u: np.ndarray, at: np.ndarray, mask: np.ndarray | None, dh_all: np.ndarray, dgates: np.ndarray) -> np.ndarray:
        du, dh = np.zeros_like(u), np.zeros((len(at), HIDDEN), np.float32)
        for t, h, z, r, n, yn in reversed(steps):
            dh = dh + dh_all[:, t]
            live = dh if mask is None else dh * mask[:, t, None]
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * yn * r * (1 - r)
            dy = np.concatenate([dz, dr, dn * r], 1)
            dgates[:, t] = np.concatenate([dz, dr, dn], 1)
            du += h.T @ dy
            dh = live * z + dy @ u.T + (0 if mask is None else dh - live)
        return du

    def gradients(self, e: np.ndarray, gates: np.ndarray, at: np.ndarray, y: np.ndarray, ids: np.ndarray, tri: np.ndarray, start: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients) of the windows ``at`` with labels y; ids, tri, start are those behind e and gates."""
        keep: dict = {}
        logit = self.forward(gates, at, keep)
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((prob - y) / len(y)).astype(np.float32)[:, None]
        h, a, w, pooled = keep["h"], keep["a"], keep["w"], keep["pooled"]
        g = {"wo": pooled.T @ d, "bo": d.sum(0)}
        dp = d @ self.p["wo"].T
        dw = np.einsum("bh,bth->bt", dp, h)
        ds = w * (dw - (w * dw).sum(1, keepdims=True))
        da = (ds.reshape(-1, 1) @ self.p["va"].T) * (1 - a * a)
        g["va"] = a.T @ ds.reshape(-1, 1)
        g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ da
        dh = w[:, :, None] * dp[:, None] + (da @ self.p["wa"].T).reshape(h.shape)
        dgates = np.zeros((*at.shape, 6 * HIDDEN), np.float32)
        g["uf"] = self._back(keep["steps"][0], self.p["uf"], at, keep["mask"], dh[:, :, :HIDDEN], dgates[:, :, : 3 * HIDDEN])
        g["ub"] = self._back(keep["steps"][1], self.p["ub"], at, keep["mask"], dh[:, :, HIDDEN:], dgates[:, :, 3 * HIDDEN :])
        rows, order = at.reshape(-1), np.argsort(at, axis=None, kind="stable")
        used, first = np.unique(rows[order], return_index=True)
        dg = np.add.reduceat(dgates.reshape(-1, 6 * HIDDEN)[order], first, axis=0)
        dg[used == 0] = 0
        g["wx"], g["bx"] = e[used].T @ dg, dg.sum(0)
        de = np.zeros_like(e)
        de[used] = dg @ self.p["wx"].T
        size = np.diff(np.append(start, len(tri)))
        owner = np.repeat(np.arange(len(ids)), size)
        g["word"], g["tri"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["tri"])
        for name, at_, d_ in (("word", ids, de[1:]), ("tri", tri, (de[1:] / size[:, None])[owner])):
            order = np.argsort(at_, kind="stable")
            rows, first = np.unique(at_[order], return_index=True)
            g[name][rows] = np.add.reduceat(d_[order], first, axis=0)
        return loss, g


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows of n words."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def cut(rows: np.ndarray) -> np.ndarray:
    """The windows of one text's input rows, padded with 0."""
    if len(rows) < WINDOW:
        return np.pad(rows, (0, WINDOW - len(rows)))[None] if len(rows) else np.zeros((0, WINDOW), np.int64)
    return rows[np.array(windows(len(rows)))[:, None] + np.arange(WINDOW)]


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> Model:
    """Fit on whole texts; without both labels the untrained model comes back with a neutral bias."""
    words = [[core(w) for w in t.split()] for t in texts]
    counts = Counter(w for ws in words for w in set(ws))
    chosen = sorted((w for w, c in counts.items() if c >= MIN_DOCUMENTS), key=lambda w: (-counts[w], w))[: VOCABULARY - 1]
    model = Model({w: i + 1 for i, w in enumerate(chosen)}, seed)
    if len(set(labels)) < 2:
        return model
    every = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    ids_all, (tri_all, start_all) = model.word_ids(list(every)), trigrams(list(every))
    size_all = np.diff(np.append(start_all, len(tri_all)))
    docs = [cut(np.array([every[w] for w in ws], dtype=np.int64)) for ws in words]
    usable = [i for i, d in enumerate(docs) if len(d)]
    stacked, bounds = np.concatenate([docs[i] for i in usable]), np.cumsum([0, *(len(docs[i]) for i in usable)])
    y = np.abs(np.array([labels[i] for i in usable], dtype=np.float32) - np.float32(NOISE))
    if not len(y):
        return model
    picks, epochs = epochs, max(epochs, -(-least_steps * BATCH // len(y)))
    rng = np.random.default_rng(seed)
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch and epoch * picks // epochs == (epoch - 1) * picks // epochs:
            pass  # the windows of before
        elif epoch:
            _, gates = model.inputs(ids_all, tri_all, start_all)
            score = np.concatenate([model.forward(gates, stacked[i : i + WINDOWS]) for i in range(0, len(stacked), WINDOWS)])
            pick = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        else:
            pick = rng.integers(bounds[:-1], bounds[1:])
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            chunk = order[i : i + BATCH]
            rows, at = np.unique(stacked[pick[chunk]], return_inverse=True)
            if rows[0] != 0:
                rows, at = np.append(0, rows), at + 1
            live = rows[1:] - 1
            size = size_all[live]
            start = np.cumsum(size) - size
            tri = tri_all[np.repeat(start_all[live] - start, size) + np.arange(size.sum())]
            ids = np.where(rng.random(len(live)) < DROP, 0, ids_all[live])
            e, gates = model.inputs(ids, tri, start)
            _, g = model.gradients(e, gates, at.reshape(-1, WINDOW), y[chunk], ids, tri, start)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k, v in model.p.items():
                d = g[k].astype(np.float32) * min(1.0, 5.0 / (norm + 1e-9)) + DECAY * v
                a, b = m[k]
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


class Scorer:
    """Scores texts with a model; keeps the inputs of words met, up to WORDS_KEPT of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > WORDS_KEPT:
            self.rows, self.gates = {}, self.gates[:1]
        flat = [w for ws in texts for w in ws]
        new = list(set(flat).difference(self.rows))
        if new or not len(self.gates):
            cores = list(map(core, new))
            _, gates = self.model.inputs(self.model.word_ids(cores), *trigrams(cores))
            at = max(len(self.gates), 1)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, gates[1:]]) if len(self.gates) else gates
        every = np.array(list(map(self.rows.__getitem__, flat)), dtype=np.int32)
        return np.split(every, np.cumsum([len(ws) for ws in texts])[:-1])

    def score(self, texts: list[str]) -> np.ndarray:
        """The worst window's probability of each text; that of an empty window for texts without words."""
        rows = [cut(r) for r in self._rows([t.split() for t in texts])]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        worst = np.full(len(texts), -np.inf)
        if len(owner):
            stacked = np.concatenate(rows)
            short = stacked[:, -1] == 0
            halves = [np.ascontiguousarray(self.gates[:, s]) for s in (slice(0, 3 * HIDDEN), slice(3 * HIDDEN, None))]
            for part in (np.flatnonzero(~short), np.flatnonzero(short)):
                for i in range(0, len(part), WINDOWS):
                    some = part[i : i + WINDOWS]
                    np.maximum.at(worst, owner[some], self.model.forward(halves, stacked[some]))
        worst[np.isneginf(worst)] = float(self.model.p["bo"][0])
        return 1 / (1 + np.exp(-worst))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most TRAIN_TOXIC and TRAIN_CLEAN labelled texts of up to TRAIN_CHARS that are not held out, those of smallest hashed ids."""
    known = labels.select(F.col("doc_id").alias("__ll_id"), F.col("toxic").cast("int").alias("__ll_y")).filter("__ll_y IN (0, 1)").distinct()
    known = known.filter(~held_out(F.col("__ll_id")))
    parts = [smallest_hashed(known.filter(F.col("__ll_y") == y), "__ll_id", most, 29) for y, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
    texts = docs.select(F.col(id_col).alias("__ll_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__ll_text")).filter(F.length("__ll_text") <= TRAIN_CHARS)
    rows = texts.join(picked, F.col("__ll_doc") == F.col("__ll_id")).select("__ll_id", "__ll_y", "__ll_text").dropDuplicates(["__ll_id", "__ll_y"]).collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return [r[2] for r in rows], [r[1] for r in rows]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Scores depend on the text alone: repeated rows get equal ones, null and empty texts that of an empty
    window. Labels are rows (doc_id, toxic); null labels, ids without a text and, of several texts of one id, all but one are
    ignored. With no usable labels scores are those of an untrained model. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    model = spark.sparkContext.broadcast(train(*sample(docs, labels, id_col, text_col)))
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            scores = np.concatenate([np.zeros(0), *(scorer.score(texts[i : i + 250]) for i in range(0, len(texts), 250))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
