import random
import re

import pytest

from fathomset.llm.winnowing import with_contamination

from .frames import SCHEMA, awkward, empty

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items, span):
    words = WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, t in items:
        own = WORD.findall((t or "").translate(LOWER))
        size = min(span, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(name or "")
    return len(words), len(hit), sorted(names), hit


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_equals_brute_force(spark, max_bytes):
    rng = random.Random(8)
    few, many = ["a", "B", "c,", "É"], [f"w{i}" for i in range(40)]
    items = [(f"i{n}", " ".join(rng.choice(rng.choice([few, many])) for _ in range(rng.choice([0, 1, 2, 4, 7, 10, 14, 30])))) for n in range(40)]
    items += [("i3", "a a a a a a a a a a a a"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    texts = [None, "", "!!"]
    for _ in range(60):
        parts = [rng.choice(items)[1] if rng.random() < 0.3 else " ".join(rng.choice(many) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 8))]
        texts.append(" ; ".join(parts))
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], SCHEMA).withColumnRenamed("lang", "contamination")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for row in with_contamination(docs, bench, max_bytes=max_bytes).collect():
        got = row["contamination_"]
        n, n_hit, names, hit = brute(row["text"], items, 10)
        spots = {w for s in got["spans"] for w in range(s["first"], s["until"])}
        assert (got["n_words"], got["n_hit"], list(got["items"]), spots) == (n, n_hit, names, hit)
        assert row["contamination"] == "x"


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_awkward_and_empty_tables(spark, max_bytes):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "same words here in both rows"), (2, None), (3, "")], "item_id long, text string")
    rows = with_contamination(docs, bench, max_bytes=max_bytes).collect()
    assert len(rows) == docs.count()
    assert sorted(r["doc_id"] for r in rows if r["contamination"]["n_hit"]) == [6, 7]
    assert with_contamination(empty(spark), bench, max_bytes=max_bytes).collect() == []
    none = with_contamination(docs, bench.limit(0), max_bytes=max_bytes).collect()
    assert len(none) == len(rows) and not any(r["contamination"]["n_hit"] for r in none)
