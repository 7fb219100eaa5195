"""Toxicity: a linear classifier of words, regularised with counterfactual texts.

A text's features are its distinct words, without case, and the words' beginnings. While learning, every labelled text that
names a group is paired with copies in which the name is swapped for other groups' names, and differences between the pair's
scores are penalised; so a neutral mention of a group cannot become a sign of toxicity. Texts without a name get one put in
front of their first word now and then, so that the penalty also reaches names the labelled texts lack.

Whole texts are scored. Defined cases: a null, empty or wordless text gets the score of the intercept alone; repeated rows are
scored each; null labels, ids or texts are not learned from; without labelled rows every score is 0; a null ``doc_id`` is never
held out; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm import labels as lab
from ocellus.llm.batches import slices

#: Labelled rows, and bytes of their texts, learned from at most.
MOST_ROWS, MOST_BYTES = 6_000, 32 << 20
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
EPOCHS = 300
#: Weight of the penalty on score differences between a text and its counterfactuals.
SWAP_PENALTY = 4.0
L2 = 1e-4
#: A feature is learned from if it is seen in so many labelled texts, and more or less often in toxic ones than chance would
#: have it (chi-squared with one degree of freedom): rare words that mean nothing would drown long texts in noise.
MIN_TEXTS, MIN_CHI2 = 3, 16.0
#: Words whose weights a worker remembers, and bytes of texts in a piece worked on at once.
MEMO_SIZE, PIECE = 100_000, 2 << 20

# Names of groups whose mention is neutral, by language.
IDENTITY = {
    "en": "women men muslims christians jews hindus buddhists immigrants refugees blacks whites asians gays lesbians muslim christian jewish hindu black white asian gay lesbian transgender woman man deaf blind disabled elderly".split(),
    "de": "frauen männer muslime christen juden einwanderer flüchtlinge schwule lesben behinderte".split(),
    "fr": "femmes hommes musulmans chrétiens juifs immigrés réfugiés noirs blancs homosexuels lesbiennes".split(),
    "es": "mujeres hombres musulmanes cristianos judíos inmigrantes refugiados negros blancos homosexuales lesbianas".split(),
}

_WORD = re.compile(r"[^\W\d_]+")
_SAME = {w: [x for x in group if x != w] for group in IDENTITY.values() for w in group}


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def swapped(named: list[str], rng: random.Random) -> tuple[list[str], list[str]] | None:
    """Names in a text (given sorted) and those that stand for them in a counterfactual; None if it has none and none is put in."""
    if not named:
        if rng.random() > 0.25:
            return None
        named = [rng.choice(sorted(_SAME))]
    return named, sorted({rng.choice(_SAME[w]) for w in named})


def fit(rows: list[tuple[str, int]], seed: int = 3) -> dict:
    """Weights of features and the intercept, by Adam on the whole sample. Texts are kept as numbers of their words only."""
    if not rows:
        return {"bias": -50.0, "weights": {}}
    rng = random.Random(seed)
    number: dict[str, int] = {}
    sets, pairs, y = [], [], np.array([label for _, label in rows], float)
    seen: dict[str, list[int]] = {}
    for text, label in rows:
        found = sorted(words(text))
        sets.append(np.array([number.setdefault(w, len(number)) for w in found], np.int32))
        pairs.append(swapped([w for w in found if w in _SAME], rng))
        for f in {f for w in found for f in features(w)}:
            seen.setdefault(f, [0, 0])[int(label)] += 1
    toxic, clean = max(y.sum(), 1), max((1 - y).sum(), 1)

    def told(in_clean: int, in_toxic: int) -> bool:
        had, lacked = in_clean + in_toxic, toxic + clean - in_clean - in_toxic
        odds = in_toxic * (clean - in_clean) - in_clean * (toxic - in_toxic)
        return had >= MIN_TEXTS and odds**2 * (toxic + clean) >= MIN_CHI2 * had * lacked * toxic * clean

    kept = sorted({f for f, n in seen.items() if told(*n)} | {f for w in _SAME for f in features(w)})
    seen.clear()
    index = {f: i for i, f in enumerate(kept)}
    for w in _SAME:
        number.setdefault(w, len(number))
    known = [[index[f] for f in features(w) if f in index] for w in number]

    def columns(ids) -> list[int]:
        return [c for i in ids for c in known[i]]

    def csr(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([c for p in parts for c in p], np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    x, row = csr([columns(s) for s in sets])
    both = [(s, *p) for s, p in zip(sets, pairs, strict=True) if p]
    numbers = lambda names: {number[w] for w in names}
    a, a_row = csr([columns(sorted(set(s.tolist()) | numbers(old))) for s, old, _ in both])
    b, b_row = csr([columns(sorted(set(s.tolist()) - numbers(old) | numbers(new))) for s, old, new in both])
    n, m, d = len(sets), len(both), len(index)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # either label counts for half
    w, bias = np.zeros(d), 0.0
    m1, m2, b1, b2 = np.zeros(d), np.zeros(d), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = bias + np.bincount(row, w[x], n)
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(x, g[row], d) + L2 * w
        if m:
            gap = np.bincount(a_row, w[a], m) - np.bincount(b_row, w[b], m)
            pull = 2 * SWAP_PENALTY * gap / m
            grad += np.bincount(a, pull[a_row], d) - np.bincount(b, pull[b_row], d)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-5)
        bias -= 0.05 * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-5)
    return {"bias": float(bias), "weights": {f: float(w[i]) for f, i in index.items() if w[i]}}


class Scorer:
    def __init__(self, model: dict):
        self.bias, self.weights = model["bias"], model["weights"]
        self.memo: dict[str, float] = {}

    def word(self, word: str) -> float:
        known = self.memo.get(word)
        if known is None:
            get = self.weights.get
            known = sum(get(f, 0.0) for f in features(word))
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            if len(word) <= 64:
                self.memo[word] = known
        return known

    def logit(self, text: str) -> float:
        return self.bias + sum(sorted(filter(None, map(self.word, words(text)))))  # sorted: the same sum in every process

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for part in slices(batches, PIECE):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.score(t or "") for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(lab.bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from labelled rows outside the held-out fold, fitted by a task."""
    rows = lab.sample(docs, labels, "toxic", lambda i: lab.bucket(i, FOLDS) != HELD_OUT, MOST_ROWS, MOST_BYTES)
    return pickle.loads(lab.fitted(rows, lambda found: pickle.dumps(fit(found))))


def clean_rows(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, as they are: each is judged where it stands, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for part in slices(batches, PIECE, place):
            yield part.filter(pa.array([own.score(str(t) if t is not None else "") < THRESHOLD for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
