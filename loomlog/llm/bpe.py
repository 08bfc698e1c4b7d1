"""Byte-level BPE with a pair occurrence index.

Texts fall into chunks (white space and the word after it), chunks into pre-tokens. The pre-tokens that a
task has not met yet are merged together: each mergeable pair is mapped to all its positions, the active
ranks are applied in ascending order, and each merge moves the neighbours' occurrences to their new lists.
Finished chunks and pre-tokens stay in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

#: The white space of the pre-tokenizer's \s (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Chunks that are one pre-token of letters only, so that most need not be searched.
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Chunks of a cache generation (there are two), and the longest chunk that is kept.
CACHE_ENTRIES = 250_000
CACHE_CHARS = 40
#: Characters whose chunks are encoded together.
BLOCK_CHARS = 6_000_000


def _byte_chars() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: bytes without one get 256 upwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _check_order(pairs: list[tuple[int, int]], made: list[int], known: list[int]) -> None:
    """Each merge joins bytes or tokens of earlier merges; only then is an ascending sweep the same as word-by-word encoding."""
    seen = set(known)
    for (a, b), new in zip(pairs, made, strict=True):
        if a not in seen or b not in seen:
            raise ValueError("a merge uses a token that a later merge makes")
        seen.add(new)


def _check_steps(spec: dict) -> None:
    """The file asks for no other steps than those that are built here: byte level, without normalisation or a leading space."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("only byte-level pre-tokenization without normaliser and leading space is supported")
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("dropout, whole-word lookups and word marks are not supported")


class PairIndexBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file (JSON with vocab, merges, added tokens)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        back, vocab = {c: b for b, c in chars.items()}, model["vocab"]
        self._byte_ids = np.array([vocab[chars[b]] for b in range(256)])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self._base = max(vocab.values()) + 1
        keys = np.array([a * self._base + b for a, b in self.pairs], dtype=np.int64)
        self._key_ranks = np.argsort(keys)
        self._keys = keys[self._key_ranks]
        self.made = [vocab[a + b] for a, b in merges]
        if len(set(self.made)) != len(self.made):
            raise ValueError("a token is made by two merges; applying ranks to a whole partition needs one each")
        _check_order(self.pairs, self.made, self._byte_ids.tolist())
        _check_steps(spec)
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with normalisation, stripping or word bounds are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self._token_bytes = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.binary())
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pretoken = regex.compile(_PRETOKEN)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it is not mergeable (negative symbols never are)."""
        key = a * self._base + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._key_ranks[at], -1)

    @staticmethod
    def _by_rank(ranks: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The places of each rank other than -1."""
        m = np.flatnonzero(ranks >= 0)
        if len(m) == 1:
            yield int(ranks[m[0]]), places[m]
        elif len(m):
            ranks, places = ranks[m], places[m]
            order = ranks.argsort(kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            yield from ((int(ranks[a]), places[a:b]) for a, b in itertools.pairwise(cuts))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian uint32) of each pre-token, all merged at once through the pair occurrence index.

        Each merge makes a token that no other merge makes, so ranks of new pairs are higher than the rank
        being applied, and one ascending sweep over the active ranks equals word-by-word encoding.
        """
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1  # a wall after each word, in no pair
        sym = np.full(ends[-1] + 1, -1, dtype=np.int64)
        inside = np.ones(len(sym), dtype=bool)
        inside[ends] = False
        sym[inside] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        left, right = np.arange(-1, len(sym) - 1), np.arange(1, len(sym) + 1)
        where = {r: [places] for r, places in self._by_rank(self._ranks(sym[:-1], sym[1:]), np.arange(len(sym) - 1))}
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (a, b), new = self.pairs[r], self.made[r]
            i = np.unique(np.concatenate(where.pop(r)))
            i = i[sym[i] == a]
            i = i[sym[right[i]] == b]
            if a == b:  # of overlapping occurrences the first, the third and so on
                free, keep = -1, []
                for p, q in zip(i.tolist(), right[i].tolist(), strict=True):
                    if p != free:
                        keep.append(p)
                        free = q
                i = np.array(keep, dtype=np.int64)
            if not len(i):
                continue
            j = right[i]
            k = right[j]
            sym[i], sym[j] = new, -2
            right[i], left[k] = k, i
            h = left[i]
            made = np.full(len(i), new)
            before = np.where(h >= 0, sym[h], -1)
            for s, places in self._by_rank(self._ranks(np.concatenate([before, made]), np.concatenate([made, sym[k]])), np.concatenate([h, i])):
                if s not in where:
                    where[s] = []
                    heapq.heappush(active, s)
                where[s].append(places)
        left_over = sym >= 0
        ids, stops = sym[left_over].astype("<u4").tobytes(), (4 * np.cumsum(left_over)[ends]).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _known(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that the cache lacks. What is met again moves to its young generation."""
        young, old, lacking = self._young, self._old, []
        for c in wanted.difference(young):
            if (x := old.get(c)) is None:
                lacking.append(c)
            else:
                young[c] = x
        return lacking

    def _learn(self, wanted: set[str]) -> list[str]:
        """Puts all wanted chunks and their pre-tokens into the young generation; returns those too long to stay there.

        A pre-token stands for the same ids as a chunk of the same characters, so both share the cache.
        """
        if len(self._young) > CACHE_ENTRIES:
            self._old, self._young = self._young, {}
        lacking, plain = self._known(wanted), _PLAIN.fullmatch
        parts = {c: self._pretoken.findall(c) for c in lacking if not plain(c)}
        words = self._known({*(c for c in lacking if c not in parts), *(w for ws in parts.values() for w in ws)})
        young = self._young
        young.update(zip(words, self.merge([w.encode() for w in words]), strict=True))
        young.update((c, b"".join([young[w] for w in ws])) for c, ws in parts.items() if len(ws) > 1)
        return [c for c in {*words, *lacking} if len(c) > CACHE_CHARS]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._split.split(t) if self._split and any(s in t for s in self.special) else (t,) for t in texts]
        chunked = [[(None, p) if p in self.special else (_CHUNK.findall(p), p) for p in ps if p] for ps in cut]
        passing = self._learn(set().union(*(cs for ps in chunked for cs, _ in ps if cs)))
        get = self._young.__getitem__
        out = [b"".join([self.special[p].to_bytes(4, "little") if cs is None else b"".join(map(get, cs)) for cs, p in ps]) for ps in chunked]
        for c in passing:
            del self._young[c]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_block([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens included; malformed UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_block(self, block: list[bytes]) -> pa.Array:
        """``decode`` of each text's ids (little-endian uint32), the tokens' bytes taken for all texts at once."""
        if not block:
            return pa.array([], pa.string())
        taken = self._token_bytes.take(pa.array(np.frombuffer(b"".join(block), "<u4")))
        if taken.null_count:
            raise KeyError("an id that the vocabulary lacks")
        starts = np.frombuffer(taken.buffers()[1], np.int32)
        places = np.cumsum([0, *(len(x) // 4 for x in block)])
        texts = pa.StringArray.from_buffers(len(block), pa.py_buffer(starts[places] if len(starts) else places.astype(np.int32)), taken.buffers()[2])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # malformed UTF-8
            return pa.array([self.decode(np.frombuffer(x, "<u4").tolist()) for x in block], pa.string())
        return texts


@lru_cache(maxsize=2)
def _loaded(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def blocks(texts: Iterable[str], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, together of about ``limit`` characters (a longer text stands alone)."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > limit:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), decoded (text) of every row.

    Null texts count as empty and give no ids. Rows keep their number and are encoded one by one, so ties
    and repeated rows need no rule. Other columns are ignored. ``path`` must exist on each executor.
    """
    arrow_limits(docs.sparkSession, 2000)
    kind = docs.schema[id_col].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            texts, at = (t or "" for t in batch.column(1).to_pylist()), 0
            for block in blocks(texts):
                ids = bpe.encode_block(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(ids, pa.binary()), bpe.decode_block(ids)], ["doc_id", "ids", "decoded"]
                )
                at += len(block)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        task, f"doc_id {kind.simpleString()}, ids binary, decoded string"
    )


def digest_columns(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_decode``'s rows."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
