"""Quality classifier: random-indexing word vectors and a two-layer network.

Every token has a sparse random index vector (from a hash of its text). A
token's vector adds up the index vectors of its neighbours over the training
sample; frequent tokens have their own vector, all others share that of their
shape (case, affixes, length). A document is the mean of its tokens' vectors,
the mean of its tokens' shape vectors, and three figures on repetition. A
network with one hidden layer is trained in numpy; its temperature is set on a
part of the sample that the training doesn't see.

The sample is bounded: at most ``max_labels`` labelled rows (a documented parameter), those least by a
hash of doc_id, whatever the length of their texts. Scores cover every whole text.

Edge cases: null, empty and blank texts get the score of a document without
tokens; labels other than 0 and 1, null among them, aren't learned from; if the labels
have one class only, or none, every score is the share of label 1 (0.5 without
labels); rows and labels that repeat count once in the sample. The caller's columns are kept, but for
one named score in whatever case, which is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sluiceway.llm.common import beside, crc_bucket, map_arrow, uniform

DIM = 48
NONZERO = 6
VOCABULARY = 12_000
KEPT_TOKENS = 200_000


def index_vector(unit: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(unit.encode("utf-8", "surrogatepass")))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return v


def shape(token: str) -> str:
    """Case, leading and trailing signs, and a rough length."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    core = token[i:j]
    if not core:
        return "\x00" + token[:3]
    case = "d" if core[0].isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "l"
    case += "x" if any(not c.isalpha() for c in core) else ""
    return f"\x00{case}{min(len(core) // 3, 4)}{token[:i][:2]}_{token[j:][:3]}"


class Vectors:
    """Token vectors: rows of one matrix; frequent tokens first, then shapes, then the unknown."""

    def __init__(self, texts: list[str]):
        docs = [t.split() for t in texts]
        seen = Counter(t for d in docs for t in d)
        words = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 2]
        shapes = Counter()
        for w, n in seen.items():
            shapes[shape(w)] += n
        kinds = [s for s, _ in sorted(shapes.items(), key=lambda x: (-x[1], x[0]))[:1000]]
        self.word = {w: i for i, w in enumerate(words)}
        self.kind = {s: len(words) + i for i, s in enumerate(kinds)}
        self.rows = len(words) + len(kinds) + 1
        index = np.stack([index_vector(u) for u in [*words, *kinds, "\x00?"]])
        total, near = np.zeros((self.rows, DIM)), np.zeros(self.rows)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        known = {w: self.ids(w) for w in seen}
        for side in (0, 1):
            ids = np.fromiter((known[t][side] for d in docs for t in d), np.int64, len(doc))
            for gap in (1, 2):
                together = doc[:-gap] == doc[gap:]
                left, right = ids[:-gap][together], ids[gap:][together]
                for a, b in ((left, right), (right, left)):
                    near += np.bincount(a, minlength=self.rows)
                    for k in range(DIM):
                        total[:, k] += np.bincount(a, index[b, k], self.rows)
        own = total / np.maximum(near, 1)[:, None] + index / NONZERO**0.5
        self.matrix = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def ids(self, token: str) -> tuple[int, int]:
        k = self.kind.get(shape(token), self.rows - 1)
        return self.word.get(token, k), k


class Features:
    """Pools whole texts; keeps what it knows of tokens up to a bound."""

    def __init__(self, vectors: Vectors):
        self.v = vectors
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        out = np.zeros(2 * DIM + 3, np.float32)
        n = len(tokens)
        if not n:
            return out
        if len(self.known) > KEPT_TOKENS:
            self.known.clear()
        counts = Counter(tokens)
        known, ids = self.known, self.v.ids
        for t in counts:
            if t not in known:
                known[t] = ids(t)
        pair = np.array([known[t] for t in counts], np.int64)
        weight = np.fromiter(counts.values(), np.float32, len(counts)) / n
        out[:DIM] = weight @ self.v.matrix[pair[:, 0]]
        out[DIM : 2 * DIM] = weight @ self.v.matrix[pair[:, 1]]
        repeats = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        out[2 * DIM :] = (repeats / n, len(counts) / n, np.log1p(n) / 10)
        return out


class Network:
    """Two layers, trained by Adam on cross-entropy, then calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 3):
        self.rate = (y.sum() + 0.5) / (len(y) + 1)
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.std
        part = rng.random(len(y)) < 0.8
        part[[np.flatnonzero(y == 0)[0], np.flatnonzero(y == 1)[0]]] = True
        a, b = z[part], y[part]
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
        m, s, t = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(b)), max(1, len(b) // 64)):
                t += 1
                h = np.tanh(a[idx] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30)))[:, 0]
                d = ((p - b[idx]) / len(idx))[:, None]
                dh = (d @ self.w[2].T) * (1 - h * h)
                for i, g in enumerate((a[idx].T @ dh + 1e-3 * self.w[0], dh.sum(0), h.T @ d + 1e-3 * self.w[2], d.sum(0))):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        held, gold = (z[~part], y[~part]) if (~part).any() else (a, b)
        logit = self.logits(held)
        loss = {k: np.logaddexp(0, np.where(gold == 1, -logit, logit) / k).mean() for k in np.geomspace(0.5, 10, 60)}
        self.temperature = min(loss, key=loss.get)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.std) / self.temperature, -50, 50)))


class Model:
    def __init__(self, sample: list[tuple[str, int]]):
        self.vectors = Vectors([t for t, _ in sample])
        f = Features(self.vectors)
        x = np.array([f.of(t) for t, _ in sample]).reshape(len(sample), 2 * DIM + 3)
        self.network = Network(x, np.array([q for _, q in sample], int))


def learn(docs: DataFrame, labels: DataFrame, *, max_labels: int = 3000) -> Model:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    gold = labels.where(F.col("quality").isin(0, 1) & (crc_bucket("doc_id", 5) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    small = F.broadcast(gold.orderBy(uniform(F.col("doc_id"), F.lit(17)), "doc_id", "quality").limit(max_labels))  # rows of two numbers
    rows = docs.select("doc_id", "text").where(crc_bucket("doc_id", 5) != 0).join(small, "doc_id").select("text", "quality").distinct()
    some = rows.orderBy(uniform(F.col("text"), F.lit(18)), "text", "quality").limit(max_labels)
    return Model(sorted((r[0] or "", r[1]) for r in some.collect()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        f = Features(m.vectors)
        for b in batches:
            x = np.array([f.of(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, 2 * DIM + 3)
            s = m.network.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(s, pa.float64())], names=["doc", "score"])

    packed = docs.select(F.struct(*beside(docs, "score")).alias("doc"), "text")
    return map_arrow(packed, run, StructType([packed.schema["doc"], StructField("score", DoubleType())])).select("doc.*", "score")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = learn(docs, labels, **options)
    rows = docs.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
