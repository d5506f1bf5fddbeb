import random

import numpy as np

from fathomset.llm import quality as Q

from .frames import SCHEMA, awkward, empty


def test_tables_learn_main_effects_and_a_pair():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = Q.fit_tables(x[:3000], y[:3000])
    assert {(a, b) for a, b, *_ in model.pairs} >= {(0, 1)}
    got = model.scores(x[3000:])
    assert ((got >= 0.5) == (y[3000:] == 1)).mean() > 0.95
    # a score is the constant plus one entry of each table, as said
    f = x[3000]
    total = model.constant + sum(t[int((f[i] >= e).sum())] for i, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    total += sum(t[int((f[a] >= ea).sum()), int((f[b] >= eb).sum())] for a, b, ea, eb, t in model.pairs)
    assert np.isclose(got[0], 1 / (1 + np.exp(-total)))


def test_no_rows_and_one_label():
    assert Q.fit_tables(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (Q.fit_tables(np.zeros((9, 3)), np.ones(9)).scores(np.zeros((2, 3))) > 0.9).all()


def test_held_out_accuracy_and_awkward_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "a", "cat", "tree", "runs", "far", "blue"]) for _ in range(60)) + ". "
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(60))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad(), None, None, None) for i in range(300)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    for r in Q.with_quality(docs.where("doc_id >= 200"), model, out="lang").collect():
        assert (r["lang_"] >= 0.7) == (r["doc_id"] % 3 > 0)
    rows = Q.with_quality(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["quality"] <= 1 for r in rows)
    assert Q.with_quality(empty(spark), model).collect() == []
    assert {r["quality"] for r in Q.with_quality(docs.limit(3), Q.fit(docs, labels.limit(0))).collect()} == {0.5}
