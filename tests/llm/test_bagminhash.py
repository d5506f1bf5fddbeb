import random
from collections import Counter

import numpy as np
import pytest

from fathomset.llm import bagminhash as B
from fathomset.llm.near import bands_for, components

from .frames import SCHEMA, awkward, empty


def weighted_jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / sum((a | b).values())


def test_registers_agree_as_often_as_bags_overlap():
    rng = np.random.default_rng(1)
    registers = 4000
    for _ in range(4):
        a = Counter({int(k): int(w) for k, w in zip(rng.integers(1, 1 << 60, 30), rng.integers(1, 40, 30), strict=True)})
        b = Counter({k: max(1, int(w * rng.uniform(0.3, 1.5))) for k, w in a.items() if rng.random() < 0.8})
        doc = np.repeat([0, 1], [len(a), len(b)])
        table = B.signatures(doc, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, registers)
        assert abs((table[0] == table[1]).mean() - weighted_jaccard(a, b)) < 0.04


def test_signatures_do_not_depend_on_the_company():
    doc, element, weight = np.array([0, 0, 1]), np.array([5, 9, 7], np.uint64), np.array([1, 12, 3])
    both = B.signatures(doc, element, weight, 2, 72)
    assert (both[1] == B.signatures(np.array([0]), element[2:], weight[2:], 1, 72)[0]).all()
    assert np.isinf(B.signatures(doc[:0], element[:0], weight[:0], 1, 8)).all()


def bag(text):
    words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [bag(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and weighted_jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {d: (min(g), len(g)) for g in groups.values() for d in g}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))]
        for copy in range(rng.choice([1, 1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), (", " if copy % 2 else " ").join(words) + "." * copy, None, None, None))
    rows += [(len(rows) + k, "same words " * n, None, None, None) for k, n in enumerate([30, 31, 45, 46, 200])]
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in B.with_classes(spark.createDataFrame(corpus, SCHEMA)).collect()}
    assert got == brute_classes(corpus)


def test_one_of_each_keeps_the_first(spark, corpus):
    kept = B.one_of_each(spark.createDataFrame(corpus, SCHEMA).withColumnRenamed("lang", "content_key"))
    assert kept.columns == ["doc_id", "text", "content_key", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute_classes(corpus).values()})


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = B.with_classes(docs).collect()
    assert len(got) == docs.count()
    sizes = {(r["doc_id"], r["class_id"]): r["class_size"] for r in got}
    assert sizes[6, 6] == sizes[7, 6] == 2 and sizes[5, 5] == 2 and sizes[2, 2] == sizes[3, 3] == 1
    kept = sorted((r["doc_id"] or -1) for r in B.one_of_each(docs).collect())
    assert kept == sorted([1, -1, -1, 2, 3, 4, 5, 6, 8, 9, 10, 11])
    assert B.with_classes(empty(spark)).collect() == [] and B.one_of_each(empty(spark)).collect() == []


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 201), (201, 202), (202, 200), (202, 202)]
    got = {r["key"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_bands_reach_the_asked_recall():
    n = bands_for(0.8, 4, 1e-4)
    assert (1 - 0.8 ** 4) ** n <= 1e-4 < (1 - 0.8 ** 4) ** (n - 1)
