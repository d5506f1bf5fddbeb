import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomset.llm import common, suffixes
from fathomset.llm.suffixes import anchors, compare_bucket, multikey_order, without_repeats

from .frames import awkward, empty

SMALL = {"length": 24, "gram": 3, "reach": 20, "widths": (20, 5, 1)}


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if starts[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = [(i, next((j for j in range(i, len(d)) if not gone[j]), len(d))) for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def troubled(seed, n=60, letters="abcdefgh"):
    """Texts with shared passages of all lengths around the least one, edits, periods, and passages with many surroundings."""
    rng = random.Random(seed)
    junk = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [junk(rng.randrange(18, 60)) for _ in range(6)]
    texts = [None, "", "a" * 70, "ab" * 40, "é" * 30, "a" * 24, junk(23)]
    for _ in range(n):
        t = junk(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(4)
            t += p[a:len(p) - rng.randrange(4)] + junk(rng.randrange(12))
        texts.append(t)
    return texts + texts[-3:]


def results(df):
    return {r.doc_id: (r.repeats.n_removed, [tuple(s) for s in r.repeats.spans], bytes(r.repeats.kept)) for r in df.collect()}


@pytest.mark.parametrize("seed, letters, bucket", [(1, "abcdefgh", 16 << 20), (2, "ab", 600), (3, "aé", 3000), (4, "abcdefgh", 900)])
def test_equals_all_windows(spark, monkeypatch, seed, letters, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    texts = troubled(seed, letters=letters)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = results(without_repeats(docs, **SMALL))
    assert [got[i] for i in range(len(texts))] == slow(texts, 24)


def test_production_sizes(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(110)) for _ in range(4)]
    texts = [" ".join(word() for _ in range(rng.randrange(150))) for _ in range(30)]
    for k in range(60):
        p = passages[k % 4]
        a, b = rng.randrange(60), rng.randrange(60)
        texts.append(" ".join(word() for _ in range(rng.randrange(30))) + p[a:len(p) - b] + " ".join(word() for _ in range(20)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = results(without_repeats(docs))
    assert [got[i] for i in range(len(texts))] == slow(texts, 400) and sum(bool(g[0]) for g in got.values()) > 20


def test_awkward_rows(spark):
    docs = awkward(spark).withColumnRenamed("lang", "repeats").withColumnRenamed("source", "row").withColumnRenamed("n_chars", "s")
    texts = [r.text for r in docs.select("text").collect()]
    got = without_repeats(docs).collect()
    found = Counter((r.text, r["repeats_"].n_removed, len(r["repeats_"].kept)) for r in got)
    assert found == Counter((t, n, len(kept)) for t, (n, _, kept) in zip(texts, slow(texts, 400), strict=True))
    assert without_repeats(empty(spark)).collect() == []


def test_order_and_neighbours():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    assert np.array_equal(keys[multikey_order(keys)], keys[np.lexsort(keys.T[::-1])])
    rows = [(1, 1, 0, b"zy", b"a" * 24), (2, 2, 0, b"zx", b"a" * 23 + b"b"), (3, 3, 0, b"q", b"c" * 24)]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                 ["core", "ctx", "shift", "back", "ahead"])
    hits = [r for b in compare_bucket(table, 24, 3, 1, 0) for r in b.to_pylist() if r["kind"] == 0]
    assert {(h["core"], h["first"], h["last"]) for h in hits} == {(1, 1, 1), (2, 1, 1)}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    shared = "".join(rng.choice("ab") for _ in range(40)).encode()
    texts = [b"abbab" * 3 + shared + b"ba", b"bb" + shared + b"aaab" * 4]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at, hi, lo, *_ = anchors(data, offsets, 24, 3, 20)
    where = {int(a - j): int(j) for a, h, low in zip(at, hi, lo, strict=True) for j in range(low, h + 1)}
    for i in range(len(shared) - 24 + 1):
        assert where[15 + i] == where[len(texts[0]) + 2 + i]


def test_workers_give_memory_back_after_a_task(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "give_back", lambda: freed.append(True))
    text = "abcdefgh" * 10
    for work, batch in ((suffixes._find_marks(24, 3, 20), pa.record_batch([pa.array([1]), pa.array([text])], ["row", "text"])),
                        (suffixes._cut_contexts(24), pa.record_batch([pa.array([text]), pa.array([[{"core": 1, "ctx": 2, "pos": 30, "hi": 4, "lo": 2}]])], ["text", "wanted"]))):
        before = len(freed)
        assert list(work(iter([batch])))
        assert len(freed) == before + 1
    assert list(suffixes._cut(iter([(pa.array([text]), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())))])))
    assert len(freed) == 3
