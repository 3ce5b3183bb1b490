"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words. Each passage becomes a vector of word shapes, hashed words and
repetition within the whole document; one tanh layer encodes it. Gated attention (a tanh and a sigmoid branch, multiplied)
gives each passage a weight, the weighted mean of the codes is the document's representation, and a logistic unit scores
it. All weights are learned together from labels of documents alone, by gradient steps written out in numpy.

Only labelled documents whose crc32(doc_id as text) mod 3 is not 1 are learned from: in order of a hash of their id, at most
SAMPLE of them and only as many as have PASSAGES passages together. That is the model's bounded sample, and what comes to the driver is
bounded with it (PASSAGES vectors). Scoring covers every word of every text, on the executors, some hundred documents at a time.

Defined results: a null or empty text is a bag of one passage without words and gets that bag's score; very long texts are scored whole;
without labels of both classes every score is the labels' smoothed mean; labels that are null are not learned from and several of one
document are averaged; of rows that share a labelled doc_id, the one whose text has the least hash is learned from; repeated rows are scored
each; a null doc_id is not held out; an empty table gives an empty result; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._common import arrow, bounded_sample, materialize, rows_in, unmaterialize, words_of

PASSAGE = 64
#: Labelled documents to learn from, at most, and the passages they may have together (some 10 MB of vectors).
SAMPLE, PASSAGES = 3000, 80_000
HASHED, SHAPES = 16, 11
WIDTH = HASHED + SHAPES + 4
SYMBOLS = b"#*$%&|<>"


#: Bytes by kind, for counting what is left without them.
_CONTINUED, _UPPER, _DIGITS, _HIGH = bytes(range(128, 192)), bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))
_LETTERS = _UPPER + bytes(range(97, 123)) + _HIGH


def shape(word: bytes) -> tuple[float, ...]:
    """Measures of one word."""
    n = len(word)
    without = word.translate
    upper = n - len(without(None, _UPPER))
    chars, other = len(without(None, _CONTINUED)), len(without(None, _LETTERS))
    return (
        min(chars, 30) / 10, upper >= 2 and word == word.upper(), (n - len(without(None, _DIGITS))) / n, (n - len(without(None, SYMBOLS))) / n,
        other / n, other == n, upper == 1 and 65 <= word[0] <= 90, (n - len(without(None, _HIGH))) / n, b"!" in word, word[-1:] in b".,;:?", chars > 20,
    )


class _Ids(dict):
    """Numbers of words; a new word enters its vector into the table of its encoder."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        e = self.encoder
        if k >= len(e.table):
            e.table = np.vstack([e.table, np.zeros_like(e.table)])
        e.table[k, :SHAPES] = shape(word)
        h = zlib.crc32(word.lower())
        e.table[k, SHAPES + h % HASHED] = 1 if h & 0x10000 else -1
        return k


class Encoder:
    """Texts to passage vectors, with the vectors of words kept in a table of bounded size."""

    def __init__(self, limit: int = 120_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.ids = _Ids(self)
        self.table = np.zeros((4096, SHAPES + HASHED), np.float32)

    def __call__(self, text: str | None) -> np.ndarray:
        """A row for each passage; one row of zeros for a text without words."""
        words = words_of(text)
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        if len(self.ids) > self.limit:
            self.forget()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        starts = np.arange(0, len(ids), PASSAGE)
        n = np.diff(np.append(starts, len(ids))).astype(np.float32)
        out = np.empty((len(starts), WIDTH), np.float32)
        # blockwise, so that a text of a million words takes no more memory than one of some thousand
        for k in range(0, len(starts), 256):
            a, b = starts[k], min(len(ids), starts[k] + 256 * PASSAGE)
            out[k : k + 256, : SHAPES + HASHED] = np.add.reduceat(self.table[ids[a:b]], starts[k : k + 256] - a, axis=0)
        out[:, : SHAPES + HASHED] /= n[:, None]
        _, first = np.unique(ids + (np.arange(len(ids)) // PASSAGE) * (self.limit * 64), return_index=True)
        out[:, -4] = np.add.reduceat(np.isin(np.arange(len(ids)), first, assume_unique=True, kind="table").astype(np.float32), starts) / n
        same = np.append(ids[1:] == ids[:-1], False)
        out[:, -3] = np.add.reduceat(same.astype(np.float32), starts) / n
        if len(ids) >= 3:
            grams = ((ids[:-2] * 1_000_003) + ids[1:-1]) * 1_000_003 + ids[2:]
            _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
            again = np.append(count[back] > 1, [False, False])
        else:
            again = np.zeros(len(ids), bool)
        out[:, -2] = np.add.reduceat(again.astype(np.float32), starts) / n
        out[:, -1] = np.log1p(n) / 4
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights by name; without weights every score is the prior."""

    prior: float
    p: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags of rows of x that begin at starts, and what the gradient needs."""
        p = self.p
        h = np.tanh((x - p["mean"]) / p["std"] @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["d"]), (h, t, s, a, z, bag)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.p is None:
            return np.full(len(bags), self.prior)
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.vstack(bags), starts)[0].astype(float)


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 60, hidden: int = 16, gate: int = 8, rate: float = 0.01, l2: float = 1e-4) -> Model:
    """Adam over minibatches of bags, both classes weighing the same; the same rows give the same model."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(prior)
    rng = np.random.default_rng(7)
    every = np.vstack(bags)
    r = lambda *n: rng.normal(0, 1 / np.sqrt(n[0]), n)
    p = {"mean": every.mean(0), "std": every.std(0) + 1e-3, "W": r(WIDTH, hidden), "b": np.zeros(hidden), "V": r(hidden, gate), "U": r(hidden, gate), "w": r(gate), "c": r(hidden), "d": np.zeros(1)}
    model, learned = Model(prior, p), ("W", "b", "V", "U", "w", "c", "d")
    m, v, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 128):
            ids = order[k : k + 128]
            x = np.vstack([bags[i] for i in ids])
            starts = np.cumsum([0, *(len(bags[i]) for i in ids)])[:-1]
            out, (h, t, s, a, z, bag) = model.forward(x, starts)
            g = (out - y[ids]) * weigh[ids] / len(ids)
            dz = g[:, None] * p["c"]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, starts)[bag])
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grads = {"W": ((x - p["mean"]) / p["std"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}
            step += 1
            for n, grad in grads.items():
                grad = grad + l2 * p[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad * grad
                p[n] = p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents of at most PASSAGES passages; their passage vectors, not their texts, come to the driver."""
    chosen = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("y"))
    chosen = bounded_sample(chosen, sample, "doc_id")  # at most sample rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        enc = Encoder()
        for ids, ys, texts in rows_in(batches, "doc_id", "y", "text", size=200):
            bags = [enc(t) for t in texts]
            digests = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "y": pa.array(ys, pa.int32()), "h": pa.array(digests, pa.int64()), "n": pa.array(map(len, bags), pa.int64()), "x": pa.array([b.tobytes() for b in bags], pa.binary())})

    # repeats of a document are settled and passages counted before anything comes to the driver
    bags = materialize(arrow(rows, run, "doc_id long, y int, h long, n long, x binary"))
    one = bags.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("first")).select("doc_id", "first.*")
    upto = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    fit_in = one.withColumn("upto", upto).filter(F.col("upto") <= PASSAGES).select("doc_id", "h", "n")  # at most sample rows
    picked = bags.join(F.broadcast(fit_in), ["doc_id", "h", "n"]).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted((r.y, bytes(r.x)) for r in picked.collect())
    unmaterialize(bags)
    return fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, x in got], np.array([y for y, _ in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of each document."""

    def run(batches):
        enc = Encoder()
        for ids, texts in rows_in(batches, "doc_id", "text", size=100):
            got = model.scores([enc(t) for t in texts])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(got, pa.float64()), "predicted": pa.array((got >= 0.5).astype(np.int32), pa.int32())})

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more. Scores are made beside the rows: no join, no shuffle."""
    schema = docs.schema

    def run(batches):
        enc = Encoder()
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(model.scores([enc(t) for t in texts]) >= 0.5))
            del batch, part, texts

    return arrow(docs, run, schema)
