"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax.

Word counts over all training documents come first (one row per word and task, then one per word). The most frequent words,
the square root of the vocabulary in number (``KNOWN`` are the bounds), are factored into classes of like frequency, with a
softmax inside each class; every other word, known or not, falls into one of ``TAILS`` classes by its first two bytes and
shares that class's smoothed count distribution. Biases start from the counts of the whole corpus.

The recurrent weights are learned from every training document by truncated backpropagation: a short fit on about ``START``
documents gives all tasks the same beginning, each task goes on from there over all of its documents, and the tasks'
weights are averaged by tokens. Scoring carries the state from window to window, so a document's every token is conditioned
on all before it.

Counts of at most ``HEAD`` most frequent words travel with the tasks; a document's rarer words, none of them frequent enough
to be a hot key, are joined with the count table and summed per document.

Defined cases: null and empty texts are the end token alone; rows without an id are training documents; repeated rows are
learned from and scored row by row; an empty table gives no rows; with nothing to learn from, all counts are zero and the
model is the base; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, stored
from .nn import Adam, Params, gru_backward, gru_forward, gru_step, init_gru

ADD = 0.1
END = b""
#: Fewest and most words with an output of their own, classes for all others, words whose counts travel with the tasks.
KNOWN, TAILS, HEAD = (256, 16_384), 64, 100_000
EMBED, HIDDEN = 16, 16
#: Documents (about) that the common beginning is learned from, and its passes over them.
START, START_EPOCHS = 200, 2
#: Learning rates of the beginning and of all documents; tokens of a window, of what is learned from with one state, rows of a batch.
RATE, RATE_ALL, WINDOW, SEGMENT, BATCH = 0.015, 0.006, 32, 512, 256
#: Rows that the tasks' weights are summed in, on their way to the driver.
SUMS = 16
#: Distinct words that a counting task holds, and tokens learned from or scored together.
HELD, TOGETHER = 400_000, 1_500_000
#: States whose classes are scored at once.
NEAR = 512
#: Sums of rows are products with these.
ONES = np.ones(1 << 10, dtype=np.float32)


def words_of(content: bytes) -> list[bytes]:
    return content.lower().split()


def tail_of(word: bytes) -> int:
    """Class of a word outside the known ones, by its first two bytes."""
    return (word[0] * 31 + (word[1] if len(word) > 1 else 0)) % TAILS


def tail_column(word):
    """``tail_of`` as an expression over a binary column."""
    byte = lambda k: F.coalesce(F.conv(F.nullif(F.hex(F.substring(word, k, 1)), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return (byte(1) * 31 + byte(2)) % TAILS


def within(states: np.ndarray, weights: np.ndarray) -> bool:
    """Whether none of these states gives one of these rows of weights a logit that needs a shift."""
    return float(max(states.max(initial=0), -states.min(initial=0)) * np.abs(weights).sum(axis=1).max(initial=0)) < 60


def exponentials(x: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - shift) in the place of x, the sums of its rows, and the shift: none unless numbers are large.

    ``small``: they are known not to be, and not looked at.
    """
    shift: np.ndarray | float = 0.0
    if not small and max(x.max(initial=0), -x.min(initial=0)) > 60:
        shift = x.max(axis=1)
        x -= shift[:, None]
    np.exp(x, out=x)
    ones = ONES[: x.shape[1]] if x.shape[1] <= len(ONES) and x.dtype == ONES.dtype else np.ones(x.shape[1], dtype=x.dtype)
    return x, x @ ones, shift


def softmax(x: np.ndarray, small: bool = False) -> np.ndarray:
    x, total, _ = exponentials(x, small)
    x *= (1 / total)[:, None]
    return x


def with_one(states: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which a layer's biases are the weights of."""
    out = np.ones((len(states), states.shape[1] + 1), dtype=states.dtype)
    out[:, :-1] = states
    return out


@dataclass
class Model:
    """Known words are numbered in class order; numbers from ``len(known)`` on are tail classes, the last one the start."""

    known: dict[bytes, int]
    classes: np.ndarray  # first word of each class, and the end
    params: Params
    _table: np.ndarray | None = None

    def number(self, word: bytes) -> int:
        got = self.known.get(word)
        return len(self.known) + tail_of(word) if got is None else got

    @property
    def start(self) -> int:
        return len(self.known) + TAILS

    def class_table(self) -> np.ndarray:
        """Class of each number: those of the known words in order, then a class for each tail."""
        if self._table is None:
            sizes = np.diff(self.classes)
            self._table = np.concatenate((np.repeat(np.arange(len(sizes)), sizes), len(sizes) + np.arange(TAILS))).astype(np.int16)  # sorted by digits, and there are few
        return self._table

    def class_of(self, targets: np.ndarray) -> np.ndarray:
        return self.class_table()[targets]

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of p(class), times p(word | class) for known words."""
        p = self.params
        own = self.class_of(targets)
        states = with_one(states)
        words = np.concatenate((p["word.W"], p["word.b"][:, None]), axis=1)
        of_class = np.concatenate((p["class.W"], p["class.b"][None]))
        small, small_class = within(states, words), within(states, of_class.T)
        out = np.empty(len(own), dtype=states.dtype)
        for a in range(0, len(own), NEAR):  # so few that they stay in the processor's cache
            logits = states[a : a + NEAR] @ of_class
            hit = logits[np.arange(len(logits)), own[a : a + NEAR]]
            _, total, shift = exponentials(logits, small_class)
            out[a : a + NEAR] = hit - np.log(total) - shift
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(self.classes)))
        for c in range(len(self.classes) - 1):
            rows = order[edges[c] : edges[c + 1]]
            if len(rows):
                a, b = self.classes[c], self.classes[c + 1]
                inner = states[rows] @ words[a:b].T
                hit = inner[np.arange(len(rows)), targets[rows] - a]
                _, total, shift = exponentials(inner, small)
                out[rows] += hit - np.log(total) - shift
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of known words and tail classes along each sequence of numbers."""
        p = self.params
        gates = p["embed"] @ p["gru.W"] + p["gru.b"]
        total = np.zeros(len(texts))
        if not texts:
            return total
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        first = np.cumsum(sizes) - sizes
        flat = np.concatenate(texts)
        before = np.concatenate(([self.start], flat[:-1]))
        before[first[sizes > 0]] = self.start
        h = np.zeros((len(texts), HIDDEN), dtype=np.float32)
        step = 0
        while len(order) and step < sizes[order[0]]:
            live = order[: int(np.searchsorted(falling, -step, side="left"))]
            span = min(WINDOW, int(sizes[order[0]]) - step)
            states, rows, places = [], [], []
            for t in range(step, step + span):
                n = int(np.searchsorted(falling, -t, side="left"))
                at = first[live[:n]] + t
                h[:n] = gru_step(gates[before[at]], h[:n], p["gru.U"])
                states.append(h[:n].copy())
                rows.append(live[:n])
                places.append(at)
            joined, docs, at = np.concatenate(states), np.concatenate(rows), np.concatenate(places)
            for a in range(0, len(docs), 1 << 15):
                s = slice(a, a + (1 << 15))
                total += np.bincount(docs[s], weights=self.log_likelihood(joined[s], flat[at[s]]), minlength=len(total))
            step += span
        return total / math.log(10)


def init(words: list[tuple[bytes, int]], tails: np.ndarray, seed: int = 5) -> Model:
    """A model with corpus counts for biases; ``words``: known words in order with counts, ``tails``: counts of tail classes."""
    rng = np.random.default_rng(seed)
    known = {w: i for i, (w, _) in enumerate(words)}
    edges = [*range(0, len(words), max(1, math.isqrt(len(words)))), len(words)]
    classes = np.array(sorted(set(edges)), dtype=np.int64)
    counts = np.array([c for _, c in words], dtype=np.float64)
    per_class = [counts[a:b].sum() for a, b in zip(classes, classes[1:])]
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    n = len(classes) - 1 + TAILS
    params = init_gru(rng, EMBED, HIDDEN, "gru") | {
        "embed": small(len(words) + TAILS + 1, EMBED) * np.float32(3), "class.W": small(HIDDEN, n), "word.W": small(len(words), HIDDEN),
        "class.b": np.log(np.concatenate((per_class, tails)) + 0.5).astype(np.float32), "word.b": np.log(counts + 0.5).astype(np.float32),
    }
    params["class.b"] -= params["class.b"].max()
    return Model(known, classes, params)


def segments(texts: list[np.ndarray]) -> list[np.ndarray]:
    """(inputs, targets) of runs of at most ``SEGMENT`` tokens, the longest first."""
    runs = [np.stack((np.concatenate(([-1], t[:-1])), t))[:, a : a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)]
    return sorted(runs, key=lambda r: -r.shape[1])


def summed(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows that belong to each of n numbers."""
    order = np.argsort(of.astype(np.int16) if n < 1 << 15 else of, kind="stable")  # by digits, if numbers are short
    sorted_of = of[order]
    first = np.flatnonzero(np.append(True, sorted_of[1:] != sorted_of[:-1]))
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    out[sorted_of[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def gradients(model: Model, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the mean log loss over one window of inputs and targets (steps by rows, -1: none), and the last state."""
    p, grads = model.params, {}
    n_classes = len(model.classes) - 1
    valid = y >= 0
    mask = None if valid.all() else valid.astype(np.float32)
    seen = np.zeros(model.start + 1, dtype=bool)
    seen[x] = True
    used, inverse = np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]
    e = p["embed"][used]
    states, kept = gru_forward((e @ p["gru.W"] + p["gru.b"])[inverse], h, p["gru.U"], mask)
    flat, target = states.reshape(-1, HIDDEN), y.ravel()
    on = np.flatnonzero(valid.ravel())
    own_class = model.class_table()[target[on]]
    order = np.argsort(own_class, kind="stable")
    on, own_class = on[order], own_class[order]
    s, target = with_one(flat[on]), target[on]
    scale = np.float32(1 / max(1, len(on)))
    of_classes = np.concatenate((p["class.W"], p["class.b"][None]))
    back, small = np.ascontiguousarray(p["class.W"].T), within(s, of_classes.T)
    of_class, d_s = np.zeros_like(of_classes), np.empty((len(on), HIDDEN), dtype=np.float32)
    for a in range(0, len(on), NEAR):  # so few that they stay in the processor's cache
        near = s[a : a + NEAR]
        d = softmax(near @ of_classes, small)
        d[np.arange(len(near)), own_class[a : a + NEAR]] -= 1
        of_class += near.T @ d
        np.matmul(d, back, out=d_s[a : a + NEAR])
    of_class *= scale
    grads["class.W"], grads["class.b"] = of_class[:-1], of_class[-1]
    words = np.concatenate((p["word.W"], p["word.b"][:, None]), axis=1)
    of_word, small, every = np.zeros_like(words), within(s, words), np.arange(len(on))
    edges = np.searchsorted(own_class, np.arange(n_classes + 1))
    for c in np.flatnonzero(np.diff(edges)).tolist():
        a, b, lo, hi = edges[c], edges[c + 1], model.classes[c], model.classes[c + 1]
        d = softmax(s[a:b] @ words[lo:hi].T, small)
        d[every[: b - a], target[a:b] - lo] -= 1
        of_word[lo:hi] = d.T @ s[a:b]
        d_s[a:b] += d @ p["word.W"][lo:hi]
    of_word *= scale
    grads["word.W"], grads["word.b"] = of_word[:, :-1], of_word[:, -1]
    d_s *= scale
    d_states = np.empty_like(flat) if mask is None else np.zeros_like(flat)
    d_states[on] = d_s
    d_gx, grads["gru.U"] = gru_backward(d_states.reshape(states.shape), kept, p["gru.U"])
    d_gates = summed(d_gx.reshape(-1, 3 * HIDDEN), inverse.ravel(), len(used))
    grads["gru.W"], grads["gru.b"] = e.T @ d_gates, d_gates.sum(axis=0)
    grads["embed"] = np.zeros_like(p["embed"])
    grads["embed"][used] = d_gates @ p["gru.W"].T
    return grads, states[-1]


def train(model: Model, texts: list[np.ndarray], adam: Adam, seed: int = 11) -> int:
    """One pass of truncated backpropagation over texts: windows in order, the state carried over, the gradient not.

    Texts of more than ``SEGMENT`` tokens are learned from in runs of so many, side by side, each from an empty state.
    """
    runs = segments([t for t in texts if len(t)])
    batches = [runs[a : a + BATCH] for a in range(0, len(runs), BATCH)]
    for b in np.random.default_rng(seed).permutation(len(batches)).tolist():
        own = batches[b]
        longest = own[0].shape[1]
        xy = np.full((2, longest, len(own)), -1, dtype=np.int64)
        for j, r in enumerate(own):
            xy[:, : r.shape[1], j] = r
        xy[0][xy[0] < 0] = model.start
        h = np.zeros((len(own), HIDDEN), dtype=np.float32)
        for a in range(0, longest, WINDOW):
            live = int((xy[1, a] >= 0).sum())  # the longest come first
            grads, h = gradients(model, xy[0, a : a + WINDOW, :live], xy[1, a : a + WINDOW, :live], h[:live])
            adam.step(grads, clip=1.0)
    return sum(map(len, texts))


def held_out(doc_id, parts: int = 10):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0


def count_words(train_docs: DataFrame) -> DataFrame:
    """``word binary, c long`` over the documents' ``text binary``; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for x in batch.column(0):
                held.update(words_of(x.as_py() or b""))
                held[END] += 1
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return train_docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What scoring needs of the counts."""

    tokens: int
    types: int
    head: dict[bytes, int]
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    model: Model


def numbers_of(model: Model, content: bytes) -> np.ndarray:
    known, none = model.known.get, len(model.known)
    words = words_of(content)
    words.append(END)
    return np.fromiter([none + tail_of(w) if (i := known(w)) is None else i for w in words], dtype=np.int64, count=len(words))


def packed_weights(tokens: int, params: Params) -> pa.RecordBatch:
    flat = np.concatenate([params[k].ravel().astype(np.float64) * tokens for k in sorted(params)])
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["tokens", "weights"])


def fit(train_docs: DataFrame, model: Model) -> Model:
    """The model, its weights learned from every document of ``text binary``: each task from the same beginning, then averaged."""
    sent = train_docs.sparkSession.sparkContext.broadcast(model)  # at most KNOWN words

    def learn_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(sent.value.known, sent.value.classes, {k: v.copy() for k, v in sent.value.params.items()})
        adam = Adam(own.params, RATE_ALL)
        texts, size, tokens = [], 0, 0
        for batch in batches:
            for x in batch.column(0):
                texts.append(numbers_of(own, x.as_py() or b""))
                size += len(texts[-1])
                if size > TOGETHER:
                    tokens += train(own, texts, adam)
                    texts, size = [], 0
        tokens += train(own, texts, adam)
        if tokens:
            yield packed_weights(tokens, own.params)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, w in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = np.frombuffer(w.as_py(), dtype=np.float64)
                tokens, total = tokens + n, flat if total is None else total + flat
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "weights"])

    shape = "tokens long, weights binary"
    parts = train_docs.select("text").mapInArrow(learn_part, shape).repartition(SUMS).mapInArrow(add, shape).collect()  # at most SUMS rows
    if not parts:
        return model
    mean = sum(np.frombuffer(r["weights"], dtype=np.float64) for r in sorted(parts, key=lambda r: bytes(r["weights"]))) / sum(r["tokens"] for r in parts)
    out, at = {}, 0
    for k in sorted(model.params):
        v = model.params[k]
        out[k] = mean[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return Model(model.known, model.classes, out)


def learn(train_docs: DataFrame, counts: DataFrame) -> Corpus:
    """Head counts and class totals (bounded, whatever the vocabulary) and the fitted model."""
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = sorted(((bytes(w), c) for w, c in most_frequent(counts, HEAD).collect()), key=lambda x: (-x[1], x[0]))
    known = head[: min(max(math.isqrt(types), KNOWN[0]), KNOWN[1])]
    if tokens and END not in {w for w, _ in known}:
        known = [*known[:-1], (END, counts.filter(F.octet_length("word") == 0).first()["c"])]
    tail_tokens, tail_types = np.zeros(TAILS), np.zeros(TAILS)
    for t, c, n in counts.filter(F.octet_length("word") > 0).groupBy(tail_column(F.col("word")).alias("t")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        tail_tokens[t], tail_types[t] = c, n
    for w, c in known:
        if w:
            tail_tokens[tail_of(w)] -= c
            tail_types[tail_of(w)] -= 1
    model = init(known, tail_tokens)
    if tokens:
        n = counts.filter(F.octet_length("word") == 0).first()["c"]  # ends: one a document
        chosen = train_docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * START / n))
        texts = [numbers_of(model, t) for t in sorted(bytes(r[0] or b"") for r in chosen.select("text").collect())]
        adam = Adam(model.params, RATE)
        for epoch in range(START_EPOCHS):
            adam.rate = RATE * (1 - 0.5 * epoch / START_EPOCHS)
            train(model, texts, adam, seed=epoch)
        model = fit(train_docs, model)
    return Corpus(tokens, types, dict(head), tail_tokens, tail_types, model)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    train_docs = slim.filter(~F.coalesce(held_out("doc_id", parts), F.lit(False)))
    counts = stored(count_words(train_docs))
    corpus = learn(train_docs, counts)
    sent = spark.sparkContext.broadcast(corpus)  # at most HEAD counts and KNOWN words
    out = "row long, doc_id long, n_tokens long, head_known long, head_sum double, log_classes double, words array<binary>, times array<int>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
    names = [c.split(" ")[0] for c in out.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        model, known = own.model, own.model.known
        at = {w: i for i, w in enumerate(own.head)}
        # by place in the head, and a last row for words outside it
        share = np.array([math.log10(c + ADD) for c in own.head.values()] + [0.0])
        numbers = np.array([model.number(w) for w in own.head] + [-1], dtype=np.int32)
        minus = np.where(numbers < len(known), share, 0.0)
        # a tail word's probability in its class; the class itself is the network's
        norm = np.array([math.log10(n + ADD * (v + 1)) for n, v in zip(own.tail_tokens, own.tail_types)])
        none = len(at)

        def flush(rows: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            found = model.scores(texts).tolist() if known else [0.0] * len(rows)
            full = [(r[0], r[1], r[2], r[3], r[4], r[5] + s, r[6], r[7]) for r, s in zip(rows, found)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*full), kinds)], names=names)

        rows, texts, size = [], [], 0
        for batch in batches:
            for row, d, x in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(x or b"")
                words.append(END)
                places = np.fromiter(map(at.get, words, repeat(none)), dtype=np.int64, count=len(words))
                ids = numbers[places]
                outside = np.flatnonzero(places == none).tolist()
                rest: dict[bytes, int] = {}
                for i in outside:
                    w = words[i]
                    ids[i] = model.number(w)
                    rest[w] = rest.get(w, 0) + 1
                # every token's log10(c + ADD) enters both scores; the known ones leave the model's again, which has its own
                log_classes = -float(minus[places].sum()) - float(norm[ids[ids >= len(known)] - len(known)].sum())
                rows.append((row, d, len(words), len(words) - len(outside), float(share[places].sum()), log_classes, list(rest), list(rest.values())))
                texts.append(ids)
                size += len(ids)
                if size > TOGETHER:
                    yield flush(rows, texts)
                    rows, texts, size = [], [], 0
        if rows:
            yield flush(rows, texts)

    scored = stored(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(score, out))
    tail = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("own"), F.col("x.times").alias("times"))
    known_tail = tail.join(counts, tail["own"] == counts["word"], "left")
    sums = known_tail.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("tail_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
    ).withColumnRenamed("row", "of_row")
    total = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0))
    base = total - F.col("n_tokens") * F.lit(math.log10(corpus.tokens + ADD * (corpus.types + 1)))
    return scored.join(sums, scored["row"] == sums["of_row"], "left").select(
        "doc_id",
        F.coalesce(held_out("doc_id", parts), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        F.round(base, 9).alias("base_score"),
        F.round(total + F.col("log_classes") if corpus.model.known else base, 9).alias("score"),
    )
