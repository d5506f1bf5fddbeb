"""The pipeline against a plain single-machine reading of each stage's rule."""

import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from fathomset.llm.token_counts import load_tokenizer

from .frames import SCHEMA
from .test_bagminhash import bag, weighted_jaccard
from .test_winnowing import brute


def corpus():
    rng = random.Random(21)
    stems = {"xx": ["the", "ing", "ation", "wh", "er", "ou"], "yy": ["los", "ado", "mente", "ci", "ue", "que"]}
    word = lambda k: "".join(rng.choice(stems[k]) for _ in range(rng.randrange(1, 5)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    item = text("xx", 30)
    rows = []
    for i in range(120):
        k = "xx" if i % 3 else "yy"
        rows.append([i, text(k, rng.randrange(5, 300)), k, f"s{i % 4}", 0])
    for i in range(120, 150):  # copies and near copies
        words = rows[i - 120][1].split()
        words[rng.randrange(len(words))] = "edit" if i % 2 and len(words) > 100 else words[0]
        rows.append([i, " ".join(words) if i % 3 else rows[i - 120][1], rows[i - 120][2], "copy", 0])
    for i in range(60, 66):
        rows[i][1] += " " + " ".join(item.split()[3:3 + 5 * (i - 58)])
    rows[70][1] += " mail me.now@host.example.com"
    rows += [[150, None, "xx", None, None], [151, "", None, None, None], [152, "123 !!", "xx", "s", 6]]
    return [tuple(r[:4]) + (len(r[1] or ""),) for r in rows], item


def test_stages_and_whole(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept, bags = [], [bag(r[1]) for r in want]
    parent = list(range(len(want)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(want)):
        for j in range(i):
            if weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    kept = [r for i, r in enumerate(want) if find(i) == i and not brute(r[1], [("0", item)], 10)[1]]
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
    after = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(after) == sorted(r[0] for r in kept)
    assert all(after[r[0]]["text"] == r[1] for r in kept if r[0] != 70)
    assert "me.now@host" not in after[70]["text"] and after[70]["n_chars"] == len(after[70]["text"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    total = {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in after.items()}
    packed = {}
    for p in pieces:
        packed[p["doc_id"]] = packed.get(p["doc_id"], 0) + p["length"]
    assert packed == total
    assert len({p["sequence_id"] for p in pieces}) <= np.ceil(sum(total.values()) / 2048) + 1
