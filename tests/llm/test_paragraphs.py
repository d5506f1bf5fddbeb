import random
import tracemalloc

import pyarrow as pa

from fathomset.llm import common
from fathomset.llm import paragraphs as P

from .frames import SCHEMA, awkward, empty


def shingle_set(line):
    words = "".join(c.lower() if c.isalnum() else " " for c in line).split()
    return len(words), {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, least=20):
    units = [(d, n, line, shingle_set(line)) for d, t, *_ in rows for n, line in enumerate((t or "").split("\n"))]
    units = [(d, n, line, s) for d, n, line, (w, s) in units if w >= least]
    parent = list(range(len(units)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (*_, a) in enumerate(units):
        for j in range(i):
            b = units[j][3]
            if len(a & b) / len(a | b) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, n, *_) in enumerate(units):
        groups.setdefault(find(i), []).append((d, n))
    return {(d, n): (*min(g), len(g), (d, n) != min(g)) for g in groups.values() if len({d for d, _ in g}) > 1 for d, n in g}


def corpus():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(15, 90))]
    shared = [passage() for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            own = list(rng.choice(shared)) if rng.random() < 0.4 else passage()
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "changed"
            lines.append(rng.choice([" ", ", "]).join(own))
        rows.append((d, "\n".join(lines), None, None, None))
    return rows


def test_clusters_equal_brute_force_and_are_cut_out(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "gone")
    want = brute(rows)
    got = P.repeated_paragraphs(docs).collect()
    assert {(r["doc_id"], r["paragraph"]): (r["cluster_doc"], r["cluster_paragraph"], r["cluster_size"], r["removed"]) for r in got} == want
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]][r["first"]:r["until"]] == texts[r["doc_id"]].split("\n")[r["paragraph"]] for r in got)
    for r in P.without_repeats(docs).collect():
        left = [line for n, line in enumerate(texts[r["doc_id"]].split("\n")) if not want.get((r["doc_id"], n), (0, 0, 0, False))[3]]
        assert r["text"] == "\n".join(left)


def test_awkward_rows(spark):
    line = " ".join(f"w{i}" for i in range(60))
    more = spark.createDataFrame([(20, line, None, None, None), (20, line, None, None, None), (None, "x\n" + line, None, None, None), (21, line + "\n" + line, None, None, None)], SCHEMA)
    got = P.repeated_paragraphs(awkward(spark).union(more)).collect()
    assert {(r["doc_id"], r["paragraph"], r["removed"]) for r in got} == {(20, 0, False), (None, 1, True), (21, 0, True), (21, 1, True)}
    assert P.without_repeats(awkward(spark)).count() == awkward(spark).count()
    assert P.repeated_paragraphs(empty(spark)).collect() == []
    assert P.repeated_paragraphs(more.where("doc_id = 20")).collect() == []


def test_workers_hold_columns_and_give_memory_back(spark, monkeypatch):
    """A batch of 4,000 texts of eight lines: with their signatures as Python objects 46 MB were traced."""
    rng = random.Random(3)
    texts = pa.array(["\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(22)) for _ in range(8)) for _ in range(4000)])
    freed = []
    monkeypatch.setattr(common, "give_back", lambda: freed.append(True))
    tracemalloc.start()
    out = list(P._sketcher(20, 14, 4, 5).func(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in out] == [4000] and {len(x) for x in out[0].to_pylist()} == {8}
    assert freed
    assert peak < 34 << 20


def test_passages_inside_long_lines(spark):
    """Words that two texts share inside longer lines and across line breaks; paragraphs alone find none of them."""
    rng = random.Random(7)
    own = lambda n: [f"é{rng.randrange(10 ** 9)}" for _ in range(n)]
    rows, shared = [], {}
    for k, n in enumerate((39, 45, 60, 60, 120, 200)):
        passage = own(n)
        for d in (2 * k, 2 * k + 1):
            head, tail = own(rng.randrange(30, 90)), own(rng.randrange(30, 90))
            rows.append((d, "x\n" + " ".join(head) + " " + ("\n" if k == 3 else ", ").join(passage) + " " + " ".join(tail), None, None, None))
            shared[d] = (1 + len(head), n)
    rows += [(90, " ".join(own(300)), None, None, None), (None, rows[0][1], None, None, None), (91, None, None, None, None), (92, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert not {r["doc_id"] for r in P.repeated_paragraphs(docs).collect()} & set(range(2, 12))
    got = P.repeated_passages(docs).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (0, None)}
    assert set(by) == set(range(1, 12))
    texts = {r[0]: r[1] for r in rows}
    for d, r in by.items():
        at, n = shared[d]
        words = texts[d].replace("\n", " ").replace(",", "").split()
        part = texts[d][r["first"]:r["until"]].replace("\n", " ").replace(",", "").split()
        begin = words.index(part[0])
        assert words[begin:begin + len(part)] == part and len(part) == r["words"]
        assert at <= begin < at + P.REACH and at + n - P.REACH < begin + len(part) <= at + n
        assert r["cluster_doc"] == d - d % 2 and r["removed"] == (d % 2 == 1) and r["paragraph"] >= 1
    # a whole copy: the null id repeats all of document 0, from its first to its last character
    copies = [r for r in got if r["doc_id"] is None]
    assert min(r["first"] for r in copies) == 0 and max(r["until"] for r in copies) == len(rows[0][1]) and all(r["removed"] and r["cluster_doc"] == 0 for r in copies)
    assert P.repeated_passages(empty(spark)).collect() == []
    assert P.repeated_passages(awkward(spark)).collect() == []
