import math
import random
from functools import lru_cache

import numpy as np

from fathomset.llm import language_id as L

from .frames import SCHEMA, awkward, empty


def brute(word, probs, unknown):
    marked = L.START + word

    @lru_cache(None)
    def total(i):
        if i == len(marked):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(marked) + 1):
            p = probs.get(marked[i:j], unknown if j == i + 1 else None)
            out += (p or 0.0) * total(j)
        return out

    return total(0)


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate([L.START, L.START + "a", "a", "b", "ab", "ba", "aba", L.START + "ab"])}
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    words = ["a", "ab", "abab", "babaab", "xa", "aaaaab", "ab" * 30]
    got = L.log_likelihoods(words, pieces, L._scaled(probs, pieces))
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            want = brute(w, {p: probs[i, k] for p, i in pieces.items()}, probs[-1, k])
            assert math.isclose(row[k], math.log(want), rel_tol=1e-9)


def test_expected_counts_add_up_to_the_letters():
    pieces = {p: i for i, p in enumerate([L.START, "a", "b", "ab", "ba", L.START + "a"])}
    scaled = L._scaled(np.full((7, 1), 1 / 7), pieces)
    words, counts = ["abba", "a", "xb"], np.array([3.0, 1.0, 2.0])
    uses = L.expected_counts(words, counts, pieces, scaled)
    sizes = np.array([len(p) for p in pieces] + [1])
    assert math.isclose((uses * sizes).sum(), sum(c * (len(w) + 1) for w, c in zip(words, counts, strict=True)))


def test_learns_and_keeps_to_defined_results(spark):
    rng = random.Random(4)
    stems = {"xx": ["the", "ing", "ation", "wh", "er"], "yy": ["los", "ado", "mente", "ci", "ue"]}
    text = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(i, text(k), k, None, None) for i, k in enumerate(["xx", "yy"] * 60)]
    model = L.fit(spark.createDataFrame(rows, SCHEMA))
    tests = spark.createDataFrame([(i, text(k), k, None, None) for i, k in enumerate(["xx", "yy"] * 20)], SCHEMA)
    assert all(r["language"]["lang"] == r["lang"] for r in L.with_language(tests, model).collect())
    docs = awkward(spark).withColumnRenamed("source", "language")
    for r in L.with_language(docs, model).collect():
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["language_"]["lang"] != "und") == lettered and 0 <= r["language_"]["score"] <= 1
    assert L.with_language(empty(spark), model).collect() == []
    none = L.fit(empty(spark))
    assert {r["language_"]["lang"] for r in L.with_language(docs, none).collect()} == {"und"}
