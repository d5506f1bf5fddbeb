import random

import public_tokenizers
import pytest

from fathomset.llm.token_counts import ChunkCounter, count_tokens, load_tokenizer, with_token_counts

from .frames import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["word", " longer", "'s", "  ", "\n", "\n\n   ", "<|endoftext|>", "<|endof", "éß", "123", "!!!", "日本", " ", "a" * 40, " " * 30, "\U0001f600"]


@pytest.mark.parametrize("chunk, overlap", [(48, 4), (64, 32), (200, 20)])
def test_spliced_counts_equal_whole_counts(chunk, overlap):
    tokenizer, rng = load_tokenizer(PATH), random.Random(chunk)
    for _ in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 120)))
        assert count_tokens(tokenizer, text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_one_endless_word():
    tokenizer = load_tokenizer(PATH)
    for text in ("a" * 3000, " " * 3000, "ab " + "!" * 999 + " z" * 500):
        assert count_tokens(tokenizer, text, 64, 8) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_awkward_rows(spark):
    docs, tokenizer = awkward(spark).withColumnRenamed("source", "n_tokens"), load_tokenizer(PATH)
    got = with_token_counts(docs, chunk=2000).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_tokens_"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert with_token_counts(empty(spark)).collect() == []


def test_remembered_counts_equal_whole_counts(monkeypatch):
    monkeypatch.setattr("fathomset.llm.token_counts.MEMO", 40)
    tokenizer, rng = load_tokenizer(PATH), random.Random(3)
    counter = ChunkCounter(tokenizer)
    parts = [*PARTS, "don't", " 'll", "It's", "\u00b2\u00bd", " \u0130", "\u017eena", "\t\t", "\r\n", "a\u0301", "\x1c", "_", "\u00a0"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(12)]
        assert counter.count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
