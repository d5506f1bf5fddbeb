import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomset.llm import katz as K

from .frames import SCHEMA, awkward, empty

SPACE = " \t\n\x0b\x0c\r"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in lowered + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return [*out, "</end>"]


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            own = tokens(t)
            self.words.update(own)
            self.pairs.update(zip(["<start>", *own], own))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.d1, self.d2 = (K.discounts(Counter(c.values())) for c in (self.words, self.pairs))
        self.unknown = 1 - sum(self.keep(c, self.d1) for c in self.words.values()) / self.n if self.n else 1.0
        self.history = Counter()
        self.followers = {}
        for (h, w), c in self.pairs.items():
            self.history[h] += c
            self.followers.setdefault(h, []).append((w, c))

    def keep(self, c, d):
        return c * d[c] if c <= K.CUT else c - K.SLIGHT

    def lower(self, w):
        return self.keep(self.words[w], self.d1) / self.n if w in self.words else self.unknown

    def weight(self, h):
        own = self.followers[h]
        return (1 - sum(self.keep(c, self.d2) for _, c in own) / self.history[h]) / (1 - sum(self.lower(w) for w, _ in own))

    def p(self, w, h):
        if (h, w) in self.pairs:
            return self.keep(self.pairs[h, w], self.d2) / self.history[h]
        return self.weight(h) * self.lower(w) if h in self.followers else self.lower(w)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.p(w, h)) for h, w in zip(["<start>", *own], own))


def corpus():
    rng = random.Random(31)
    common = ["the", "The", "of", "a"]
    return [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(common) if rng.random() < 0.5 else f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(60))),
             "x", None, None) for i in range(200)]


@pytest.mark.parametrize("block", [1 << 30, 500])
def test_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rows = corpus()
    learn = lambda i: i % 5 != 2
    model = Brute([t for i, t, *_ in rows if learn(i)])
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "score").repartition(3)
    got = K.score_texts(docs, F.col("doc_id") % 5 != 2).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in model.words for w in own), model.n)
        assert math.isclose(r["base_score"], sum(math.log10((model.words[w] + 1) / (model.n + model.v + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(texts[r["doc_id"]]), rel_tol=1e-9, abs_tol=1e-12)


def test_every_history_sums_to_one():
    model = Brute([t for _, t, *_ in corpus()])
    for h in ["<start>", "the", "of", "w1", "w70", "never seen"]:
        total = sum(model.p(w, h) for w in model.words) + model.p("an unknown token", h)
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_planes_and_discounts():
    for values in ([], [0], [255, 256, 1], [1 << 50, 3]):
        assert K._from_planes(K._planes(np.array(values, np.uint64))).tolist() == values
    assert all(0 < d < 1 for d in K.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6})[1:])
    assert K.discounts({})[1:].tolist() == [(r - 0.5) / r for r in range(1, K.CUT + 1)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = Brute([r["text"] for r in docs.collect()])
    got = K.score_texts(docs).collect()
    want = sorted((r["doc_id"] or -1, round(model.score(r["text"]), 6)) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in got) == want
    assert K.score_texts(empty(spark)).collect() == []
    untaught = K.score_texts(docs, F.lit(False)).collect()
    assert {(r["score"], r["base_score"], r["n_known"]) for r in untaught} == {(0.0, 0.0, 0)}


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("doc-a", "one two two"), (None, "two"), ("7", None)], "doc_id string, text string")
    got = K.score_texts(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "None", "doc-a"] and {r.doc_id: r.n_tokens for r in got} == {"doc-a": 4, None: 2, "7": 1}
