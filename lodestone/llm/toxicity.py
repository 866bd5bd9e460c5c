"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is its embedding joined with the mean embedding of its character trigrams. Windows of ``LENGTH`` words every
``STRIDE`` words cover a whole text; the network scores all of them, and the largest score is the text's. It is trained in
numpy on the driver from at most ``POSITIVE + NEGATIVE`` labelled texts (by a hash of their id): every epoch scores all
windows of these texts, and learns from the highest ones of each.

Defined cases: null and empty texts are one window without words; labels that are null are ignored; with one class only
every score is that class's; repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .nn import Adam, Params, gru_backward, gru_forward, gru_step, init_gru, sigmoid

LENGTH, STRIDE = 32, 16
#: Labelled texts learned from, at most, of either class; words with an embedding of their own.
POSITIVE, NEGATIVE, VOCABULARY = 800, 1200, 20_000
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTENTION = 8, 8, 8, 8
BUCKETS = 1 << 13
EPOCHS, MIN_STEPS, RATE, ROWS = 5, 200, 0.02, 128
#: Windows, and bytes of text, scored together.
WINDOWS, TOGETHER = 8192, 1 << 20
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"


def words_of(content: bytes) -> list[bytes]:
    return content.lower().split()


def trigram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte trigrams of ``<word>`` for each word, and how many each word has."""
    whole = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    h = (whole[:-2] * np.uint32(0x9E3779B1)) ^ (whole[1:-1] * np.uint32(0x85EBCA6B)) ^ (whole[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> 15
    ends = np.cumsum(sizes)
    inside = np.ones(len(whole) - 2, dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False
    return (h[inside] % BUCKETS).astype(np.int64), sizes - 2


def means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean row of each run of ``counts`` rows; zero for an empty run."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    ends = np.cumsum(counts)
    return ((total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]).astype(np.float32)


def windows_of(n: int, length: int = LENGTH, stride: int = STRIDE) -> list[int]:
    """Starts of the overlapping windows that cover n words."""
    return list(range(0, max(1, n - length + stride), stride))


def window_rows(ids: np.ndarray, none: int) -> np.ndarray:
    """Windows of word numbers, filled up with ``none``."""
    starts = windows_of(len(ids))
    padded = np.full(starts[-1] + LENGTH, none, dtype=np.int64)
    padded[: len(ids)] = ids
    return padded[np.array(starts)[:, None] + np.arange(LENGTH)]


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    params: Params
    constant: float | None = None

    def number(self, words: list[bytes]) -> np.ndarray:
        """Row of each word's own embedding; the last row is for unknown ones."""
        none = len(self.vocabulary)
        return np.array([self.vocabulary.get(w.strip(EDGES), none) for w in words], dtype=np.int64)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        own = self.params["word"][self.number(words)]
        stripped = [w.strip(EDGES) for w in words]
        buckets, counts = trigram_buckets(stripped)
        return np.concatenate((own, means(self.params["char"][buckets], counts)), axis=1)

    def window_scores(self, rows: np.ndarray, none: int, gates: dict[str, np.ndarray]) -> np.ndarray:
        """Scores of windows of word numbers; gates: each number's share of the gates, for both directions."""
        p, out = self.params, np.empty(len(rows), dtype=np.float32)
        for a in range(0, len(rows), WINDOWS):
            ids = np.ascontiguousarray(rows[a : a + WINDOWS].T)
            mask = (ids != none).astype(np.float32)
            states = np.empty((LENGTH, ids.shape[1], 2 * HIDDEN), dtype=np.float32)
            for name, part, order in (("right", slice(0, HIDDEN), range(LENGTH)), ("left", slice(HIDDEN, None), range(LENGTH - 1, -1, -1))):
                h = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32)
                full = mask.all(axis=1)
                for t in order:
                    after = gru_step(gates[name][ids[t]], h, p[f"{name}.U"])
                    h = after if full[t] else np.where(mask[t][:, None] > 0, after, h)
                    states[t, :, part] = h
            weight = np.exp(np.tanh(states @ p["attend.W"]) @ p["attend.v"]) * mask
            weight /= weight.sum(axis=0) + np.float32(1e-9)
            pooled = np.einsum("tn,tnh->nh", weight, states)
            out[a : a + WINDOWS] = sigmoid(pooled @ p["out.w"] + p["out.b"][0])
        return out

    def scores(self, contents: list[bytes]) -> list[float]:
        """The largest window score of each text."""
        if self.constant is not None:
            return [self.constant] * len(contents)
        index: dict[bytes, int] = {}
        number = index.setdefault
        ids = [[number(w, len(index)) for w in words_of(c)] for c in contents]
        none = len(index)
        x = self.inputs([*index, b""])
        gates = {k: x @ self.params[f"{k}.W"] + self.params[f"{k}.b"] for k in ("right", "left")}
        parts = [window_rows(np.array(i, dtype=np.int64), none) for i in ids]
        if not parts:
            return []
        all_scores = self.window_scores(np.concatenate(parts), none, gates)
        first = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        return np.maximum.reduceat(all_scores, first).round(6).tolist()


def gradients(model: Model, words: np.ndarray, none: int, buckets: np.ndarray, counts: np.ndarray, first: np.ndarray, rows: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> Params:
    """Gradients of the weighted log loss over windows ``rows`` of word numbers with labels ``y``."""
    p = model.params
    used, inverse = np.unique(rows, return_inverse=True)
    inverse = inverse.reshape(rows.shape).T
    mask = (rows.T != none).astype(np.float32)
    n = counts[used]
    at = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    x = np.concatenate((p["word"][words[used]], means(p["char"][buckets[at]], n)), axis=1)
    out, runs = {}, {}
    for name, step in (("right", 1), ("left", -1)):
        gates = x @ p[f"{name}.W"] + p[f"{name}.b"]
        h = np.zeros((len(rows), HIDDEN), dtype=np.float32)
        states, kept = gru_forward(gates[inverse[::step]], h, p[f"{name}.U"], mask[::step])
        runs[name] = (states[::step], kept)
    states = np.concatenate([runs["right"][0], runs["left"][0]], axis=2)
    t = np.tanh(states @ p["attend.W"])
    e = np.exp(t @ p["attend.v"]) * mask
    weight = e / (e.sum(axis=0) + np.float32(1e-9))
    pooled = np.einsum("tn,tnh->nh", weight, states)
    score = sigmoid(pooled @ p["out.w"] + p["out.b"][0])
    d = ((score - y) * weigh / weigh.sum()).astype(np.float32)
    out["out.w"], out["out.b"] = pooled.T @ d, d.sum(keepdims=True)
    d_pooled = d[:, None] * p["out.w"][None, :]
    d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
    d_states = weight[:, :, None] * d_pooled[None]
    d_logit = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_t = d_logit[:, :, None] * p["attend.v"] * (1 - t * t)
    out["attend.v"] = np.einsum("tn,tnk->k", d_logit, t)
    out["attend.W"] = np.einsum("tnh,tnk->hk", states, d_t)
    d_states += d_t @ p["attend.W"].T
    d_x = np.zeros_like(x)
    for name, step, part in (("right", 1, slice(0, HIDDEN)), ("left", -1, slice(HIDDEN, None))):
        d_gx, out[f"{name}.U"] = gru_backward(d_states[::step, :, part], runs[name][1], p[f"{name}.U"])
        d_gates = np.zeros((len(used), 3 * HIDDEN), dtype=np.float32)
        np.add.at(d_gates, inverse[::step].ravel(), d_gx.reshape(-1, 3 * HIDDEN))
        out[f"{name}.W"], out[f"{name}.b"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x += d_gates @ p[f"{name}.W"].T
    out["word"] = np.zeros_like(p["word"])
    np.add.at(out["word"], words[used], d_x[:, :WORD_DIMS])
    out["word"][-1] = 0
    out["char"] = np.zeros_like(p["char"])
    np.add.at(out["char"], buckets[at], np.repeat(d_x[:, WORD_DIMS:] / np.maximum(n, 1)[:, None], n, axis=0))
    return out


def evidence(positive: np.ndarray, negative: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log odds of counts in texts of either class, in standard errors, squashed: a start for the first dimension."""
    a, b = positive + 0.5, negative + 0.5
    z = (np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))) / np.sqrt(1 / a + 1 / b)
    return np.tanh(z / 4).astype(np.float32)


def train(contents: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """Rows come in a fixed order; everything drawn comes from ``seed``."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model({}, {}, float(y[0]) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    texts = [np.array([index.setdefault(w, len(index)) for w in words_of(c)], dtype=np.int64) for c in contents]
    words = [*index, b""]
    none = len(index)
    stripped = [w.strip(EDGES) for w in words]
    seen: dict[bytes, list[int]] = {}
    for ids, label in zip(texts, labels):
        for w in {stripped[i] for i in ids}:
            seen.setdefault(w, [0, 0])[label] += 1
    chosen = sorted((w for w, (a, b) in seen.items() if a + b >= 3 and w), key=lambda w: (-sum(seen[w]), w))[:VOCABULARY]
    vocabulary = {w: i for i, w in enumerate(chosen)}
    n1, n0 = int(y.sum()), int((1 - y).sum())
    params: Params = init_gru(rng, WORD_DIMS + CHAR_DIMS, HIDDEN, "right") | init_gru(rng, WORD_DIMS + CHAR_DIMS, HIDDEN, "left")
    small = lambda *shape: rng.standard_normal(shape).astype(np.float32) * np.float32(0.1)
    params |= {"word": small(len(chosen) + 1, WORD_DIMS), "char": small(BUCKETS, CHAR_DIMS), "attend.W": small(2 * HIDDEN, ATTENTION), "attend.v": small(ATTENTION), "out.w": small(2 * HIDDEN), "out.b": np.zeros(1, dtype=np.float32)}
    counts01 = np.array([seen[w] for w in chosen], dtype=np.float64).reshape(-1, 2)
    params["word"][:-1, 0] = evidence(counts01[:, 1], counts01[:, 0], n1, n0)
    params["word"][-1] = 0
    model = Model(vocabulary, params)
    numbers = model.number(words)
    buckets, counts = trigram_buckets(stripped)
    first = np.cumsum(counts) - counts
    parts = [window_rows(t, none) for t in texts]
    rows = np.concatenate(parts)
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(sizes) - sizes
    adam = Adam(params, RATE)
    per_epoch = int(np.ceil((y.sum() + 4 * (len(y) - y.sum())) / ROWS))
    epochs = max(EPOCHS, -(-MIN_STEPS // per_epoch))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        x = np.concatenate((params["word"][numbers], means(params["char"][buckets], counts)), axis=1)
        s = model.window_scores(rows, none, {k: x @ params[f"{k}.W"] + params[f"{k}.b"] for k in ("right", "left")})
        if epoch == 0:  # an untrained network can't choose: the window with most evidence stands for a positive text
            own = np.append(params["word"][:, 0], 0)[np.where(rows == none, len(params["word"]), numbers[rows])]
            s = own.max(axis=1) + s * np.float32(1e-3)
        top = []
        for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
            order = np.argsort(-s[a : a + n], kind="stable")
            take = order[:1] if y[i] else np.concatenate((order[:3], rng.integers(0, n, 1)))
            top += [(a + j, y[i]) for j in take.tolist()]
        picked = np.array([x for x, _ in top])
        target = np.array([x for _, x in top], dtype=np.float32)
        heavy = max(1.0, (len(target) - target.sum()) / target.sum() / 3)  # positive texts have one window here, negative ones four
        order = rng.permutation(len(picked))
        for a in range(0, len(order), ROWS):
            k = order[a : a + ROWS]
            adam.step(gradients(model, numbers, none, buckets, counts, first, rows[picked[k]], target[k], np.where(target[k] > 0, heavy, 1).astype(np.float32)))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 5, positive: int = POSITIVE, negative: int = NEGATIVE, doc_id: str = "doc_id", text: str = "text") -> list[tuple[bytes, int]]:
    """At most so many labelled texts of either class whose crc32(doc_id) isn't held out, in a fixed order."""
    own = labels.select(F.col(doc_id).cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).filter("label_id is not null and label in (0, 1)")
    own = own.filter(F.crc32(F.col("label_id").cast("string").cast("binary")) % held_out != 0)
    order = (F.xxhash64("label_id"), F.col("label_id"))
    chosen = own.filter("label = 1").orderBy(*order).limit(positive).union(own.filter("label = 0").orderBy(*order).limit(negative))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    got = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(F.xxhash64("doc_id"), "doc_id", "text", "label").collect()
    return [(bytes(r[2] or b""), r[3]) for r in sorted(got, key=lambda r: (r[0], r[1], bytes(r[2] or b""), r[3]))]


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    rows = training_rows(docs, labels, **kw)
    return train([r[0] for r in rows], [r[1] for r in rows])


def scorer(model: Model, docs: DataFrame):
    """A function of a batch's texts that gives their scores, some texts at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words and BUCKETS trigram rows

    def score(batch: pa.RecordBatch, column: int) -> pa.Array:
        return pa.array([x for part in slices(batch, column, TOGETHER) for x in sent.value.scores([t.as_py() or b"" for t in part.column(column)])], pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; the model is bounded and travels with the task."""
    score = scorer(model, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), score(batch, 1)], names=["doc_id", "score"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def kept_documents(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns as they are, whatever their names."""
    score = scorer(model, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = pc.less(score(batch, 1), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on)], names=["row"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("binary").alias("text"))
    return whole.mapInArrow(run, T.StructType([whole.schema["row"]])).select("row.*")
