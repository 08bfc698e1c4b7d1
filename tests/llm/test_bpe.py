import json
import random

import numpy as np
import pytest

from loomlog.llm import bpe
from loomlog.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    return bpe.PairIndexBPE(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())


def test_equals_library_on_random_texts(both):
    own, lib = both
    rng = random.Random(1)
    letters = "ab 's\n\t  é漢1٣!'re<|endoftext|>\xa0　\x1c\x85😀́’"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "aaaa" * 57 + "a", "ababab" * 9, "<|endoftext|>", " <|endoftext|> x", "a  b   <|endoftext|>  ", "x" * 50_000, "the them then " * 99]
    for text, ids, ref in zip(texts, own.encode_block(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == ref.ids, text
        assert own.decode(got) == lib.decode(ref.ids, skip_special_tokens=False) == text


def test_files_that_ask_for_other_steps_are_refused(tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)

    def load(**change):
        (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
        return bpe.PairIndexBPE(str(tmp_path / "t.json"))

    merges = spec["model"]["merges"]
    assert load().encode("the") == bpe.PairIndexBPE(tokenizer_path()).encode("the")
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"dropout": 0.1}}, {"model": spec["model"] | {"merges": merges[::-1]}}):
        with pytest.raises(ValueError):
            load(**change)


def test_cache_generations_do_not_change_ids(both, monkeypatch):
    own = bpe.PairIndexBPE(tokenizer_path())
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    texts = [f"word{i % 7} other{i % 5} the" for i in range(60)]
    assert [own.encode(t) for t in texts] == [both[0].encode(t) for t in texts]


def test_operator_rows(spark, both):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, "a b", None), (2, None, "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {(r.doc_id, r.decoded): np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_decode(df, tokenizer_path()).collect()}
    assert out == {(1, "Hello there"): both[1].encode("Hello there").ids, (None, "a b"): both[1].encode("a b").ids, (2, ""): [], (3, ""): []}
    assert bpe.encode_decode(df, tokenizer_path()).count() == 5
    assert bpe.digest_columns(bpe.encode_decode(df.limit(0), tokenizer_path())).collect() == []


def test_blocks_equal_the_library_and_merge_no_pre_token_twice(both, monkeypatch):
    """Chunks that share pre-tokens across blocks: each is merged once, and a block is decoded at once from its ids."""
    own, merged = bpe.PairIndexBPE(tokenizer_path()), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda words: merged.extend(words) or merge(words))
    long = "y" * (bpe.CACHE_CHARS + 1)
    blocks = [["one two", "", "straße déjà ǅ ª × x²", long], ["(one) one, two. two!", " two<|endoftext|>", "日本 \U0001f600", long]]
    for texts in blocks:
        ids = own.encode_block(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [both[1].encode(t, add_special_tokens=False).ids for t in texts]
        assert own.decode_block(ids).to_pylist() == texts
    assert sorted(w for w in set(merged) if merged.count(w) > 1) == [long.encode()]  # too long to be kept
    assert long not in own._young and own.decode_block([]).to_pylist() == own.decode_block([b""]).to_pylist()[:0]
    lone = np.array([own._byte_ids[0x80]], "<u4").tobytes()
    assert own.decode_block([lone, ids[0]]).to_pylist() == ["�", blocks[1][0]] and own.decode_block([b"", b""]).to_pylist() == ["", ""]
