import hashlib
import random

from fathomset.llm import fingerprints as P

from .frames import SCHEMA, awkward, empty


def slow_chunks(text):
    raw, out, at = text.encode(), {}, 0
    gear = [int(g) for g in P._GEAR]
    cut_after = []
    for i in range(len(raw)):
        back = [raw[i - k] if i >= k else 0 for k in range(P.WINDOW)]
        cut_after.append(sum(gear[b] << k for k, b in enumerate(back)) % (1 << 32))
    while at < len(raw):
        cut = min(at + P.MOST, len(raw))
        for e in range(at + P.LEAST, cut):
            bits = P.STRICT_BITS if e < at + P.NORMAL else P.LOOSE_BITS
            if cut_after[e - 1] >> (32 - bits) == 0:
                cut = e
                break
        out[P.xxhash.xxh64_intdigest(raw[at:cut])] = cut - at
        at = cut
    return out


def test_chunks_as_defined_one_by_one_and_together():
    rng = random.Random(9)
    texts = ["", "a", "é" * 700] + ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randrange(2000))) for _ in range(12)]
    got = P.chunk_sets(texts)
    assert got == [slow_chunks(t) for t in texts] == [P.chunk_sets([t])[0] for t in texts]
    assert [P.from_text(P.to_text(c)) for c in got] == got


def test_an_insertion_leaves_most_chunks():
    rng = random.Random(10)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(2000))
    a, b = P.chunk_sets([text, text[:3000] + "inserted" + text[3000:]])
    assert P.likeness(a, b) > 0.95 and P.likeness(a, a) == 1


def check(rows, got):
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: (r[0], r[1] or ""))
    following = {id(r): order[(k + 1) % len(order)][1] or "" for k, r in enumerate(order)}
    want = []
    for r in rows:
        t, f = r[1] or "", following.get(id(r), "")
        e = P.edited(t, f)
        own, new, nxt = P.chunk_sets([t, e, f])
        want.append((-1 if r[0] is None else r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), P.to_text(own), P.to_text(new), P.likeness(own, new), P.likeness(own, nxt)))
    have = [(-1 if g["doc_id"] is None else g["doc_id"], *g[1:]) for g in got]
    assert sorted(have) == sorted(want)


def test_neighbours_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 7)
    rng = random.Random(11)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") * 5 for _ in range(rng.randrange(80))), "en", None, None) for i in range(100)]
    rng.shuffle(rows)
    check(rows, P.compare_edits(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_awkward_rows(spark):
    docs = awkward(spark).withColumnRenamed("lang", "fingerprint")
    check([tuple(r) for r in docs.collect()], P.compare_edits(docs).collect())
    assert P.compare_edits(empty(spark)).collect() == []
    one = awkward(spark).where("doc_id = 9")
    check([tuple(r) for r in one.collect()], P.compare_edits(one).collect())
    assert {r["fingerprint_"] for r in P.with_fingerprint(docs.where("text = ''")).collect()} == {""}
