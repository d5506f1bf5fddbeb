import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from fathomset.llm.packing import WordEncoder, best_fit_decreasing, lower_bound, pack, pack_documents
from fathomset.llm.token_counts import load_tokenizer

from .frames import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_words_encode_as_whole_texts():
    tokenizer, encoder, rng = load_tokenizer(PATH), WordEncoder(PATH), random.Random(1)
    parts = ["Word", "don't", "we'll", "É", "straße", "ŒUVRE", "12", "!?", "'s", "\n", " ", " ", "<|endoftext|>", "é", "İ", "ΣΑΣ", "\x1c", "_", "ª", "日本"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(600)]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bound_is_never_above_a_packing_and_proves_known_cases():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins, _ = best_fit_decreasing(lengths, 100)
        assert lower_bound(lengths, 100) <= bins.max() + 1
    assert lower_bound(np.full(9, 51), 100) == 9
    assert lower_bound(np.full(9, 34), 100) == 5
    assert lower_bound(np.array([], int), 100) == 0


def test_rounds_keep_every_piece_and_close_gaps(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([3, 10, 33, 60, 100]), i) for i in range(3000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(items, 100, per_partition=100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    used = check_layout(got, 100)
    at_once = best_fit_decreasing(np.array([r[3] for r in rows]), 100)[0].max() + 1
    assert used <= 1.01 * at_once + 1


def test_awkward_rows(spark):
    docs, tokenizer = awkward(spark), load_tokenizer(PATH)
    got = pack_documents(docs).collect()
    check_layout(got, 2048)
    want = defaultdict(list)
    for d in docs.collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            own = ids[s:s + 2048]
            want[d["doc_id"]].append((p, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert pack_documents(empty(spark)).collect() == []


def test_words_are_kept_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr("fathomset.llm.packing.MEMO_WORDS", 5)
    tokenizer, encoder = load_tokenizer(PATH), WordEncoder(PATH)
    for texts in (["one two three"], ["four five six seven one", "Two zebra"], ["four, one!"], ["eight"]):
        ids = [list(memoryview(b).cast("I")) for b in encoder.encode(texts)]
        assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.memo) <= 5 and "one" in encoder.memo
