"""Language identification with piece probabilities summed over all segmentations of a word.

The pieces are those of a public vocabulary.  A word's probability under a language is the sum, over all ways to cut
it into pieces, of the product of the pieces' probabilities, which a forward pass gives.  Probabilities come from
expectation maximisation over word counts of labelled documents; a document's log-likelihood is the sum over its
words.  Words are runs of letters, lower-cased, with a word-start mark; a run of over ``LONGEST`` letters counts as
several words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import fresh, give_back, quoted, text_groups

#: Labelled documents per language that the fit reads, about; a uniform sample by hash of the text.
TRAIN_ROWS = 500
ROUNDS = 3
LANGUAGES = 500
LONGEST = 60
SMOOTH = 0.05
#: Words that a worker remembers at most.
MEMO_WORDS = 200_000
#: Per-letter factor that keeps forward sums near one; taken out again in the logarithm.
LETTER = 16.0

_RUN = re.compile(r"[^\W\d_]+")
START = "▁"


@functools.cache
def vocabulary(path: str) -> dict[str, int]:
    """Lower-cased pieces of letters, with or without the word-start mark, numbered."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lower()
            if piece.removeprefix(START).isalpha() or piece == START:
                found.setdefault(piece, len(found))
    return found


def words_of(text: str) -> list[str]:
    """Letter runs of a text, lower-cased; long ones in parts."""
    runs = _RUN.findall(text.lower())
    if any(len(r) > LONGEST for r in runs):
        return [r[i:i + LONGEST] for r in runs for i in range(0, len(r), LONGEST)]
    return runs


def _lattice(words: list[str], pieces: dict[str, int], longest: int) -> tuple[np.ndarray, ...]:
    """All pieces in all words: (word, begin, end, piece); a letter outside the vocabulary is piece ``len(pieces)``."""
    rows, begins, ends, ids = [], [], [], []
    unknown, get = len(pieces), pieces.get
    for w, word in enumerate(words):
        marked = START + word
        size = len(marked)
        for i in range(size):
            for j in range(i + 1, min(size, i + longest) + 1):
                p = get(marked[i:j])
                if p is None:
                    if j > i + 1:
                        continue
                    p = unknown
                rows.append(w)
                begins.append(i)
                ends.append(j)
                ids.append(p)
    return tuple(np.array(x, np.int64) for x in (rows, begins, ends, ids))


def _forward(n: int, lattice: tuple[np.ndarray, ...], probs: np.ndarray) -> np.ndarray:
    """Sums over segmentations: array (position, word, language); ``probs`` are scaled per letter."""
    rows, begins, ends, ids = lattice
    alpha = np.zeros((int(ends.max(initial=0)) + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    order = np.lexsort((rows, ends))
    rows, begins, ends, ids = rows[order], begins[order], ends[order], ids[order]
    for e in range(1, len(alpha)):
        a, b = np.searchsorted(ends, [e, e + 1])
        if a < b:
            r = rows[a:b]
            flows = alpha[begins[a:b], r] * probs[ids[a:b]]
            heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            alpha[e, r[heads]] = np.add.reduceat(flows, heads)
    return alpha


def _scaled(probs: np.ndarray, pieces: dict[str, int]) -> np.ndarray:
    """Piece probabilities times LETTER per letter; the last row is a letter outside the vocabulary."""
    sizes = np.ones(len(pieces) + 1)
    for p, i in pieces.items():
        sizes[i] = len(p)
    return probs * LETTER ** sizes[:, None]


def log_likelihoods(words: list[str], pieces: dict[str, int], scaled: np.ndarray) -> np.ndarray:
    """log p(word | language), one row a word."""
    if not words:
        return np.zeros((0, scaled.shape[1]))
    alpha = _forward(len(words), _lattice(words, pieces, max(map(len, pieces), default=1)), scaled)
    sizes = np.array([len(w) + 1 for w in words])
    return np.log(alpha[sizes, np.arange(len(words))]) - np.log(LETTER) * sizes[:, None]


def expected_counts(words: list[str], counts: np.ndarray, pieces: dict[str, int], scaled: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, weighted by the words' counts (one language)."""
    lattice = _lattice(words, pieces, max(map(len, pieces), default=1))
    rows, begins, ends, ids = lattice
    n, sizes = len(words), np.array([len(w) + 1 for w in words])
    alpha = _forward(n, lattice, scaled)
    mirrored = (rows, sizes[rows] - ends, sizes[rows] - begins, ids)
    beta = _forward(n, mirrored, scaled)  # sums over segmentations of what follows, by distance from the end
    total = alpha[sizes, np.arange(n), 0]
    use = alpha[begins, rows, 0] * scaled[ids, 0] * beta[sizes[rows] - ends, rows, 0] / total[rows]
    return np.bincount(ids, weights=use * counts[rows], minlength=len(pieces) + 1)


@dataclass
class Model:
    """Languages, pieces that occur in training (or are letters), and their scaled probabilities."""

    languages: list[str]
    pieces: dict[str, int]
    scaled: np.ndarray


def _probabilities(expected: np.ndarray) -> np.ndarray:
    return (expected + SMOOTH) / (expected + SMOOTH).sum(axis=0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None, train_rows: int = TRAIN_ROWS,
        rounds: int = ROUNDS) -> Model:
    """Fit on rows with a language and a text, about ``train_rows`` of each language (whole texts).

    What reaches the driver is bounded by languages times vocabulary.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    rows = labelled.select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages, pieces = sorted(sizes), vocabulary(path)
    if not languages:
        return Model([], {}, np.zeros((1, 0)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, train_rows / sizes[k])))])
    unit = F.shiftrightunsigned(F.xxhash64("t", F.lit(11)), 11) / float(1 << 53)

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([[w for w in words_of(t) if any(map(str.isalpha, w))] for group in text_groups(column) for t in group], pa.list_(pa.string()))

    chosen = rows.where(unit < share[F.col("lang")])
    counts = settle(chosen.select("lang", F.explode(split("t")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")))
    expected = np.zeros((len(pieces) + 1, len(languages)))
    place = {k: i for i, k in enumerate(languages)}
    probs = np.full_like(expected, 1 / len(expected))
    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast(_scaled(probs, pieces))

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, total, at = vocabulary(path), np.zeros(sent.value.shape), {k: i for i, k in enumerate(languages)}
            for frame in frames:
                for k, part in frame.groupby("lang"):
                    for a in range(0, len(part), 4000):
                        some, c = part.iloc[a:a + 4000], at[k]
                        total[:, c] += expected_counts(some["w"].tolist(), some["n"].to_numpy(float), own, sent.value[:, [c]])
            i, c = np.nonzero(total)
            yield pd.DataFrame({"piece": i, "lang": [languages[x] for x in c], "uses": total[i, c]})
            give_back()

        sums = counts.repartition("w").mapInPandas(expect, "piece long, lang string, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        expected = np.zeros_like(expected)
        for r in sums.collect():
            expected[r["piece"], place[r["lang"]]] = r["uses"]
        probs = _probabilities(expected)
    kept = [(p, i) for p, i in pieces.items() if len(p) == 1 or expected[i].max() > 1e-3]
    own = {p: n for n, (p, _) in enumerate(kept)}
    return Model(languages, own, _scaled(_probabilities(expected[[i for _, i in kept] + [len(pieces)]]), own))


class Scorer:
    """Scores texts under a model, remembering the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.model.languages)))
        self.letters = np.zeros(1024, bool)

    def _learn(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > MEMO_WORDS:
            self._forget()
        need = len(self.memo) + len(words)
        if need > len(self.values):
            size = 2 * need
            self.values = np.resize(self.values, (size, self.values.shape[1]))
            self.letters = np.resize(self.letters, size)
        for a in range(0, len(words), 2000):
            part = words[a:a + 2000]
            has = np.array([any(map(str.isalpha, w)) for w in part])
            at = len(self.memo)
            self.values[at:at + len(part)] = log_likelihoods(part, self.model.pieces, self.model.scaled) * has[:, None]
            self.letters[at:at + len(part)] = has
            self.memo.update(zip(part, range(at, at + len(part)), strict=True))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        unseen = [w for w in set().union(*words) if w not in self.memo]
        before = len(self.memo)
        self._learn(unseen)
        if len(self.memo) < before + len(unseen):  # emptied on the way
            self._learn([w for w in set().union(*words) if w not in self.memo])
        look, out = self.memo.__getitem__, []
        for own in words:
            at = np.fromiter(map(look, own), np.int64, len(own))
            if not self.letters[at].any():
                out.append(("und", 0.0))
                continue
            total = self.values[at].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def language_scorer(docs: DataFrame, model: Model):
    """An Arrow UDF: text -> struct (lang, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for column in batches:
            found = [x for group in text_groups(column) for x in scorer.score(group)]
            yield pa.array([{"lang": k, "score": s} for k, s in found], kind)
        del scorer
        give_back()

    return predict


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct (lang, score); score is the posterior of the language under equal priors.

    Texts that are null, empty or without a letter, and all texts under a model without languages, are ``und`` with
    score 0.  Equal likelihoods go to the language first by name.  Repeated rows are scored alike; other columns pass
    through and ``out`` gets a free name if it is taken.
    """
    return docs.withColumn(fresh(docs, out), language_scorer(docs, model)(quoted(text)))


def accepted(language: Column, least: float = 0.5) -> Column:
    """Whether a document stays: a language was found and is likelier than all others together."""
    return (language["lang"] != "und") & (language["score"] >= least)
