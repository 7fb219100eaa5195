"""Quality: a byte-level convolutional network in numpy.

A text's bytes, folded to 64 kinds, are covered whole by overlapping chunks of 8 bytes, one every 4; learned filters respond to
each chunk, and each filter's strongest response in the text is kept. A second bank of learned filters looks at how well
overlapping chunks of 32 bytes, one every 16, match the bytes a few places before them, which tells repeated words of any
spelling. A logistic layer combines all maxima into one probability.

Since only maxima count, a text of any length takes fixed memory beyond its own: long ones are gone through in overlapping pieces.
The network is fitted by one task on a bounded sample of labelled rows (MOST_ROWS rows and MOST_BYTES bytes of text). Defined
cases: a null or empty text has responses of 0, and is scored like any other; repeated rows are scored each; null labels, ids or
texts are not learned from; without labelled rows every score is 0.5; a null ``doc_id`` is never held out; other columns are
ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm import labels as lab
from ocellus.llm.batches import slices

#: Labelled rows, and bytes of their texts, learned from at most.
MOST_ROWS, MOST_BYTES = 3_000, 16 << 20
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
WIDTH, STRIDE, FILTERS = 8, 4, 24
#: Distances at which bytes are compared with earlier ones, the chunk over which matches are averaged, and that bank's filters.
LAGS = np.arange(2, 33)
SPAN, LAG_FILTERS = 32, 8
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: Bytes of texts looked at in one go, at least one text.
PIECE = 1 << 19


def _folding() -> np.ndarray:
    """Capitals and small letters stay apart; bytes from 128 on share 4 kinds."""
    fold = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            fold[b] = 60 + b % 4
        elif c.isalpha():
            fold[b] = 1 + ord(c.lower()) - ord("a") if c.islower() else 27 + (ord(c) - ord("A")) % 13
        elif c.isdigit():
            fold[b] = 40
        else:
            kinds = [" ", "\n\r", "\t", ".", ",", "!", "?", "#", "*", "$", "%", "&", "|", "<>", "-_", "'\"`", "()[]{}", ":;"]
            fold[b] = next((41 + i for i, k in enumerate(kinds) if c in k), 59)
    return fold


FOLD = _folding()


class Layout:
    """Texts laid out one after the other, each padded to whole half spans, two at least; pads are of kind 0 and match nothing."""

    def __init__(self, texts: list[bytes]):
        half = SPAN // 2
        sizes = np.array([len(t) for t in texts], np.int64)
        room = half * np.maximum(2, -(-sizes // half))
        self.starts, total = np.cumsum(room) - room, int(room.sum())
        self.room = room
        self.raw = np.zeros(total, np.uint8)
        self.kind = np.zeros(total, np.uint16)
        self.place = np.zeros(total, np.uint8)  # bytes of its text before it, counted to 255
        for at, text in zip(self.starts, texts, strict=True):
            part = np.frombuffer(text, np.uint8)
            self.raw[at : at + len(part)] = part
            self.kind[at : at + len(part)] = FOLD[part]
            self.place[at : at + min(255, len(part))] = np.arange(min(255, len(part)))
            self.place[at + 255 : at + len(part)] = 255

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair codes, four to a chunk, of the chunks of all texts (those across two texts among them), and where a text's begin."""
        pair = self.kind[0::2] << np.uint16(6) | self.kind[1::2]
        n = len(self.raw) // STRIDE - 1
        return np.stack([pair[j : j + 2 * n - 1 : 2] for j in range(WIDTH // 2)], 1), self.starts // STRIDE

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk of SPAN bytes, the share of bytes equal to those at each distance before, to the fourth power; likewise."""
        half = SPAN // 2
        n = len(self.raw) // half
        out = np.zeros((n - 1, len(LAGS)), np.float32)
        same, ones = np.zeros(len(self.raw), bool), np.uint64(0x0101010101010101)
        for k, lag in enumerate(LAGS):
            np.equal(self.raw[lag:], self.raw[:-lag], out=same[lag:])
            same &= self.place >= lag
            eights = (same.view(np.uint64) * ones) >> np.uint64(56)  # how many of eight bytes are set
            sums = (eights[0::2] + eights[1::2]).astype(np.float32)
            share = (sums[:-1] + sums[1:]) * np.float32(1 / SPAN)
            share *= share
            np.multiply(share, share, out=out[:, k])
        return out, self.starts // half

    def maxima(self, values: np.ndarray, begins: np.ndarray, step: int) -> np.ndarray:
        """Row maxima of each text: a text's rows end one before the next text's begin, since no chunk may cross."""
        ends = begins + self.room // step - 1
        return np.maximum.reduceat(values, np.stack([begins, ends], 1).ravel()[: 2 * len(begins) - (ends[-1] >= len(values))], 0)[::2]


class Network:
    """Filters and the logistic layer. ``pooled`` is a text's vector of maxima."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "t": rng.normal(0, 0.3, (WIDTH, 64, FILTERS)).astype(np.float32),
            "c": np.zeros(FILTERS, np.float32),
            "g": rng.normal(0, 0.5, (len(LAGS), LAG_FILTERS)).astype(np.float32),
            "d": np.zeros(LAG_FILTERS, np.float32),
            "w": rng.normal(0, 0.1, FILTERS + LAG_FILTERS).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.shift = 0.0
        self.pairs: np.ndarray | None = None

    def _tables(self) -> np.ndarray:
        """Filters over pairs of kinds, from those over kinds."""
        if self.pairs is None:
            t = self.p["t"]
            self.pairs = np.stack([(t[2 * j][:, None, :] + t[2 * j + 1][None, :, :]).reshape(4096, FILTERS) for j in range(WIDTH // 2)])
        return self.pairs

    def respond(self, codes: np.ndarray) -> np.ndarray:
        tables = self._tables()
        out = tables[0][codes[:, 0]]
        for j in range(1, WIDTH // 2):
            out += tables[j][codes[:, j]]
        return out

    def respond_lags(self, match: np.ndarray) -> np.ndarray:
        """Distance by distance: a matrix product may round by its number of rows, and a text's score must not depend on its batch."""
        out = match[:, :1] * self.p["g"][0]
        for k in range(1, len(LAGS)):
            out += match[:, k : k + 1] * self.p["g"][k]
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Each text's vector of maxima, over the whole text."""
        lay = Layout(texts)
        codes, begins = lay.chunks()
        a = lay.maxima(self.respond(codes), begins, STRIDE)
        match, begins = lay.matches()
        b = lay.maxima(self.respond_lags(match), begins, SPAN // 2)
        return np.maximum(np.concatenate([a + self.p["c"], b + self.p["d"]], 1), 0)

    def pooled_long(self, text: bytes) -> np.ndarray:
        """:meth:`pooled` of one text longer than PIECE. Pieces overlap by a span and the longest distance, so every chunk lies whole in
        one of them together with the bytes that it is compared with."""
        lead = 2 * SPAN
        a = b = np.float32(-np.inf)
        for at in range(0, len(text), PIECE):
            lay = Layout([text[max(0, at - lead) : at + PIECE]])
            a = np.maximum(a, self.respond(lay.chunks()[0]).max(0))
            match = lay.matches()[0][2 if at else 0 :]  # a later piece's first two chunks lack bytes before them
            b = np.maximum(b, self.respond_lags(match).max(0))
        return np.maximum(np.concatenate([a + self.p["c"], b + self.p["d"]]), 0)[None]

    def probabilities(self, texts: list[bytes]) -> list[float]:
        """Of each text, worked out for about PIECE bytes of texts at a time."""
        z: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            until, size = at, 0
            while until < len(texts) and (until == at or size + len(texts[until]) <= PIECE):
                size += len(texts[until])
                until += 1
            pooled = self.pooled(texts[at:until]) if size <= PIECE else self.pooled_long(texts[at])
            terms = pooled.astype(np.float64) * self.p["w"]
            part = np.zeros(len(terms))
            for k in range(terms.shape[1]):  # in this order, however many texts there are
                part += terms[:, k]
            z.append(part)
            at = until
        total = np.concatenate(z) + float(self.p["b"][0]) + self.shift if z else np.zeros(0)
        return (1 / (1 + np.exp(-np.clip(total, -30, 30)))).tolist()


def fit(rows: list[tuple[str, int]], seed: int = 5) -> Network:
    """Adam on shuffled batches; gradients go through each filter's strongest chunk only."""
    net = Network(seed)
    if not rows:
        net.p["w"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t, _ in rows]
    data = [(lay.chunks()[0], lay.matches()[0]) for lay in (Layout([r]) for r in raw)]
    y = np.array([label for _, label in rows], np.float32)
    share = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in net.p.items()}
            for i in order[at : at + BATCH]:
                codes, match = data[i]
                a, b = net.respond(codes), match @ net.p["g"]
                ia, ib = a.argmax(0), b.argmax(0)
                x = np.maximum(np.concatenate([a[ia, range(FILTERS)] + net.p["c"], b[ib, range(LAG_FILTERS)] + net.p["d"]]), 0)
                z = float(x @ net.p["w"] + net.p["b"][0])
                g = float(share[i]) * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
                grad["w"] += g * x
                grad["b"] += g
                back = g * net.p["w"] * (x > 0)
                grad["c"] += back[:FILTERS]
                grad["d"] += back[FILTERS:]
                for f in np.flatnonzero(back[:FILTERS]):
                    pair = codes[ia[f]]
                    grad["t"][np.arange(WIDTH), np.stack([pair >> 6, pair & 63], 1).ravel(), f] += back[f]
                grad["g"] += match[ib].T * back[FILTERS:]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, p in net.p.items():
                d = grad[k] / BATCH + 1e-4 * p
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
            net.pairs = None
    p = np.clip(np.array(net.probabilities(raw)), 1e-13, 1 - 1e-13)
    z = np.log(p / (1 - p))
    # Put the threshold where both labels are told apart best.
    cuts = np.unique(np.quantile(z, np.linspace(0, 1, 201)))
    right = [((z >= c) & (y == 1)).sum() / max(y.sum(), 1) + ((z < c) & (y == 0)).sum() / max((1 - y).sum(), 1) for c in cuts]
    top = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cuts[top[len(top) // 2]])
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p, own.shift = shared.value
        for part in slices(batches, 4 * PIECE):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.probabilities([(t or "").encode() for t in part.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(lab.bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from labelled rows outside the held-out fold, fitted by a task."""
    rows = lab.sample(docs, labels, "quality", lambda i: lab.bucket(i, FOLDS) != HELD_OUT, MOST_ROWS, MOST_BYTES)
    net = Network()
    net.p, net.shift = pickle.loads(lab.fitted(rows, lambda found: pickle.dumps((lambda n: (n.p, n.shift))(fit(found)))))
    return net
