import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fathomset.llm import alignment
from fathomset.llm.alignment import Aligned, Memory, byte_ends, encoders, with_agreement, with_groups

from .frames import awkward, empty

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["word", " longer", "'s", "  ", "\n", " \n\n   ", "<|endoftext|>", " <s>", "éß", " 123", "!!!", " 日本", "日", " ", " x", "<0x41>", "\t", "\x00",
         *map(chr, (0x1F600, 0x2581, 0x85, 0xA0, 0x451, 0xE01, 0x301, 0xFEFF, 0x2003, 0xE0041))]


def slow(texts):
    """Whole texts, token by token, on sets of byte positions."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    char = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
    rows, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        ba = [bytes(char[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            rows.append(None)
            continue
        spans = []
        for parts in (ba, bb):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        owners = [[k for k, (s, e) in enumerate(own) for _ in range(s, e)] for own in spans]
        links = [(ia[x], ib[y]) for x, y in dict.fromkeys(zip(*owners, strict=True))]
        cuts = [0, *sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})]
        groups = []
        for s, e in zip(cuts, cuts[1:]):
            sides = [",".join(str(ids[k]) for k in dict.fromkeys(own[s:e])) for ids, own in zip((ia, ib), owners, strict=True)]
            groups.append("|".join(sides))
        rows.append((len(ia), len(ib), groups, links))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = r
            out.append((na, nb, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def mixed_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)] + ["plain words only", "plain words only", None, ""]


@pytest.mark.parametrize("rows, bound", [(200_000, 8 << 20), (0, 0)])
def test_equals_whole_texts_both_joins(spark, monkeypatch, rows, bound):
    monkeypatch.setattr("fathomset.session.BROADCAST_BYTES", bound)
    texts = mixed_texts(150, rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, agreement string")
    got = {r.doc_id: tuple(r["agreement_"]) for r in with_agreement(docs).collect()}
    assert [got[i] for i in range(len(texts))] == slow(texts)
    assert sum(r[0] > 0 for r in got.values()) > 50 and any(t and not got[i][0] for i, t in enumerate(texts))


def test_spans_are_refined_by_decoded_bytes():
    # three tokens share the span of one three-byte character, then a token with a span of its own
    ends = byte_ends(np.array([0, 1, 1, 1, 4]), np.array([1, 4, 4, 4, 6]), np.array([1, 1, 1, 1, 2]))
    assert ends.tolist() == [1, 2, 3, 4, 6]
    assert byte_ends(np.array([0, 0]), np.array([2, 2]), np.array([1, 1])).tolist() == [1, 2]
    found = Aligned(np.array([1, 2]), np.array([2, 4]), np.array([7, 8, 9]), np.array([1, 3, 4]))
    assert [x.tolist() for x in found.common()] == [[2], [3]] and len(found.pairs()) == 4
    assert found.written(encoders(A_PATH, B_PATH)) == "1,2|7,8,9"


def test_units_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "ROW", 40)
    monkeypatch.setattr(alignment, "MEMO", 60)
    tools = encoders(A_PATH, B_PATH)
    assert tools.in_units
    memory = Memory(tools)
    for seed in range(25):
        texts = mixed_texts(12, seed)
        places, rows = memory.find(texts)
        begins = np.append(0, np.cumsum(rows.counts[:, 3]))
        for t, p, whole in zip(texts, places, tools.aligned(texts), strict=True):
            assert bool(p) == (whole is not None)
            if p:
                assert ";".join(rows.written[i] for i in p) == whole.written(tools)
                assert np.concatenate([rows.pairs[begins[i]:begins[i + 1]] for i in p]).tolist() == whole.pairs().tolist()
                assert rows.counts[p].sum(axis=0).tolist() == [len(whole.a), len(whole.b), len(whole.common()[0]), len(whole.pairs())]
    assert 0 < len(memory.at) <= 60


def test_few_units_are_met_again(monkeypatch):
    """Words are known whatever punctuation or line break stands beside them, and rows that are held are not copied."""
    words = ["wordé", "don't", "x", "123", "ÀB", "日本", "a\u2581b"]
    marks = [", ", ".\n", "; ", "! ", "-", "|", " (", ")\n", ".\n\n", " ", "'s ", "\n", "...\n", "', ", "÷", ".\r\n"]
    texts = ["".join(w + m for w in words) + w + m * k for m in marks for w in words for k in range(2)]
    tools = encoders(A_PATH, B_PATH)
    assert [tools.units(t) for t in ("a word, or\nanother.", " b", "c\n d.")] == [[" a", " word", ",", " or", "\nanother", "."], ["  b"], [" c\n d", "."]]
    monkeypatch.setattr(alignment, "ROW", 60)
    memory = Memory(tools)
    for _ in range(2):
        places, rows = memory.find(texts)
        for t, p, whole in zip(texts, places, tools.aligned(texts), strict=True):
            assert "".join(tools.units(t)) == " " + t and bool(p) == (whole is not None)
            assert not p or ";".join(rows.written[i] for i in p) == whole.written(tools)
    plain = [w + m for w in ("one", "two", "three", "four") for m in ",.;:!?"]
    memory = Memory(tools)
    memory.find([" ".join(plain)])
    assert len(memory.at) == 10  # each word once, each mark once (24 before)
    held = memory.held.pairs
    memory.encoded = lambda units: units and pytest.fail("known units are encoded again") or alignment.Found.none()
    memory.find([" ".join(reversed(plain))])
    assert memory.held.pairs is held


def test_groups_and_awkward_rows(spark):
    docs = awkward(spark)
    got = with_groups(docs.withColumnRenamed("lang", "groups")).select("text", "groups_").collect()
    assert len(got) == docs.count()
    for r in got:
        assert not r["groups_"] or r["groups_"][-1]["end"] == len((" " + r.text).encode())
    rows = with_agreement(docs.withColumnRenamed("source", "row").withColumnRenamed("lang", "a.b")).collect()
    expected = Counter(zip([r.text for r in rows], slow([r.text for r in rows]), strict=True))
    assert Counter((r.text, tuple(r.agreement)) for r in rows) == expected
    assert with_agreement(empty(spark)).collect() == [] and with_groups(empty(spark)).collect() == []
