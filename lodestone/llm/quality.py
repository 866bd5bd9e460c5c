"""Learned decision lists over text statistics, emitted as ordered Spark conditions.

Statistics are DataFrame expressions over whole texts; nothing leaves the JVM. The list is learned on the driver from the
statistics of at most ``TRAIN_ROWS`` labelled documents (chosen by a hash of their id): sequential covering grows a
conjunction of thresholds on two thirds of them, prunes it on the last third, keeps it if it is precise there, takes out
what it covers and goes on. ``verdict`` turns the list into one ``CASE WHEN`` in order.

Defined cases: a null text has no words and fails the base rules; texts without words have zero for every ratio; words and
windows are compared by 64-bit hash; repeated rows are judged row by row; an empty table gives no rows; no labels, or one
class of labels only, gives an empty list that keeps what the base rules keep; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Labelled rows that a list is learned from, at most (about).
TRAIN_ROWS = 20_000
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_TERMS, THRESHOLDS = 0.9, 5, 24, 4, 48
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "shout_ratio", "distinct_ratio", "digit_ratio")


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Term, ...]


def pairwise(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base counts, and the features of the list, for every row."""
    t = F.col("t")
    words = F.col("words")
    n = F.col("n_words")
    hashed = F.col("hashed")
    first = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = first.select(
        "doc_id",
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long").alias("n_digits"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
        F.array_remove(F.split(t, SPACE), "").alias("words"),
    )
    counted = split.select(
        "doc_id", "word_chars", "n_symbols", "n_shouts", "n_upper", "n_digits",
        F.size(words).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashed"),
    )
    # windows of five by shifting: pairs, fours, fives; what runs over the end is sliced off
    most = F.size(hashed)
    shifted = lambda c, k: F.slice(c, k + 1, most)
    paired = counted.withColumn("pair", pairwise(hashed, shifted(hashed, 1), lambda a, b: F.xxhash64(a, b)))
    foured = paired.withColumn("four", pairwise(F.col("pair"), shifted(F.col("pair"), 2), lambda a, b: F.xxhash64(a, b)))
    fived = foured.withColumn("five", F.slice(pairwise(F.col("four"), shifted(hashed, 4), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(most - (WINDOW - 1), F.lit(0))))
    # positions only where some window repeats
    placed = F.when(F.size(F.array_distinct("five")) < F.size("five"), F.sort_array(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    sorted_windows = fived.withColumn("by_hash", placed)
    same = lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))
    twice = F.filter(pairwise(F.col("by_hash"), F.slice("by_hash", 2, most), same), lambda x: x.isNotNull())
    starts = sorted_windows.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(twice))))
    step = pairwise(F.col("starts"), F.slice("starts", 2, most), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(step, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return (
        starts.withColumn("n_repeat_words", repeated)
        .withColumn("distinct_words", F.size(F.array_distinct("hashed")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ratio(F.col("word_chars"), n).alias("mean_word"), ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
            ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"), ratio(F.col("n_repeat_words"), n).alias("repeat_ratio"),
            ratio(F.col("n_upper"), F.col("word_chars")).alias("upper_ratio"), ratio(F.col("n_shouts"), n).alias("shout_ratio"),
            ratio(F.col("distinct_words"), n).alias("distinct_ratio"), ratio(F.col("n_digits"), F.col("word_chars")).alias("digit_ratio"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def gain(covered: np.ndarray, y: np.ndarray, p0: float, n0: float) -> float:
    p, n = float((covered & y).sum()), float((covered & ~y).sum())
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))) if p else -1.0


def grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: list[Term] = []
    on = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_TERMS and (on & ~y).any():
        p0, n0 = float((on & y).sum()), float((on & ~y).sum())
        best, chosen = 1e-6, None
        for f in FEATURES:
            cuts = np.unique(np.quantile(x[on, FEATURES.index(f)], np.linspace(0, 1, THRESHOLDS), method="lower"))
            for c in cuts.tolist():
                for above in (True, False):
                    term = Term(f, above, c)
                    g = gain(on & term.holds(x), y, p0, n0)
                    if g > best:
                        best, chosen = g, term
        if chosen is None:
            break
        higher = (v := x[on, FEATURES.index(chosen.feature)])[v > chosen.threshold]
        if len(higher):  # midway to the next value: the same rows here, a wider margin elsewhere
            chosen = Term(chosen.feature, chosen.above, (chosen.threshold + float(higher.min())) / 2)
        rule.append(chosen)
        on &= chosen.holds(x)
    return tuple(rule)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), dtype=bool)
    for term in rule:
        on &= term.holds(x)
    return on


def worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    on = covers(rule, x)
    p, n = int((on & y).sum()), int((on & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    best, value = rule, worth(rule, x, y)
    for k in range(len(rule) - 1, 0, -1):
        if (v := worth(rule[:k], x, y)) >= value:
            best, value = rule[:k], v
    return best


def learn(x: np.ndarray, rejected: np.ndarray) -> list[Rule]:
    """Rules that reject, in order; rows are features and labels in a fixed order."""
    rules: list[Rule] = []
    held = np.arange(len(rejected)) % 3 == 2
    left = np.ones(len(rejected), dtype=bool)
    while len(rules) < MAX_RULES:
        g, p = left & ~held, left & held
        if (rejected & g).sum() < MIN_COVER or not (~rejected & g).any():
            break
        rule = prune(grow(x[g], rejected[g]), x[p], rejected[p])
        on = covers(rule, x) & left
        if not rule or (on & rejected).sum() < MIN_COVER or (on & rejected).sum() < MIN_PRECISION * on.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False by the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        on = rule[0].column()
        for term in rule[1:]:
            on &= term.column()
        out = F.when(on, False) if out is None else out.when(on, False)
    return out.otherwise(True)


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics and ``label`` of about ``rows`` labelled documents at most."""
    own = labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label")).filter("label_id is not null and label is not null")
    n = own.count()
    if n > rows:
        own = own.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen = slim.join(F.broadcast(own), slim["doc_id"] == own["label_id"]).select("doc_id", "text", "label")
    # the label rides along as a pair with the id
    stats = statistics(chosen.select(F.struct("doc_id", "label").alias("doc_id"), "text"))
    return stats.select("doc_id.doc_id", "doc_id.label", *[c for c in stats.columns if c != "doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> list[Rule]:
    """A decision list that rejects what is labelled 0 (among what the base rules let through)."""
    stats = labelled_statistics(docs, labels, label, rows, doc_id, text)
    # sorted and filtered here, on a bounded list: a Spark filter would be pushed down into the statistics and compute them again
    got = sorted(tuple(r) for r in stats.select(F.xxhash64("doc_id"), base_failed(), "label", *FEATURES).collect())
    table = np.array([r[2:] for r in got if not r[1]], dtype=np.float64)
    return learn(table[:, 1:], table[:, 0] == 0) if len(table) else []


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics with ``base_failed`` and ``kept`` for every row. To filter on these, use ``kept_documents``."""
    return statistics(docs, doc_id, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_documents(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rules and the list keep."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col(text).alias("text"))
    # the partition id is not deterministic for the optimizer: it keeps the filter above the statistics, which are then computed once
    judged = judge(row, rules).select("doc_id", "kept", F.spark_partition_id().alias("part"))
    return judged.filter(F.col("kept") & (F.col("part") >= 0)).select("doc_id.*")
