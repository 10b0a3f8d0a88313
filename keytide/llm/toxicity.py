"""Toxicity severity by cumulative-link ordinal regression on sparse words.

P(grade <= k | x) = sigmoid(cut_k - w.x): one weight vector for all ordered
cuts.  Features are words and beginnings of words, those that a
likelihood-ratio test on the sample ties to toxic texts, with value
1 + log(count).  The labels say only toxic or not, so grades are 0 for texts
that aren't, and 1, 2, 3 for the thirds of toxic texts by how much of those
features they hold.  The model is fitted on the driver on at most MAX_LABELLED
labelled rows and MAX_WORDS features; every document is scored in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import text_slices

MAX_LABELLED = 20_000
MAX_WORDS = 1024
#: A word must be in so many sampled texts, and pass this likelihood ratio or
#: twice the log of the number of words tested, whichever is more.
MIN_TEXTS = 3
MIN_RATIO = 15.0
GRADES = 4
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5, 6)
L2 = 5e-5
STEPS = 800
RATE = 0.05
REJECT_FROM = 0.5
WORD = re.compile(r"\w+")


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 30.0))

    def __post_init__(self):
        self.starts = {w[: STEMS[0]] for w in self.words if w.endswith("*")}

    def features(self, text: str | None) -> dict[int, float]:
        """Index -> 1 + log(count) of the model's words in a whole text."""
        counts: dict[int, int] = {}
        known, starts = self.words, self.starts
        for w in WORD.findall((text or "").lower()):
            if w in known:
                counts[known[w]] = counts.get(known[w], 0) + 1
            if w[: STEMS[0]] in starts:
                for n in STEMS:
                    if len(w) > n and (k := known.get(w[:n] + "*")) is not None:
                        counts[k] = counts.get(k, 0) + 1
        return {k: 1 + math.log(n) for k, n in counts.items()}

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. GRADES-2, a row per score."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.cuts[None, :], -60, 60)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.array([sum(self.weights[k] * v for k, v in self.features(t).items()) for t in texts], float).reshape(-1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_cols: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by full-batch Adam on the penalised likelihood.

    Cuts stay ordered: the first is free, each next adds the exponential of a
    parameter.  Grades that don't occur leave their cuts where the rest puts
    them.
    """
    n, k = len(grades), GRADES - 1
    w, c = np.zeros(n_cols), np.concatenate([[1.0], np.zeros(k - 1)])
    m, v = np.zeros(n_cols + k), np.zeros(n_cols + k)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([c[:1], np.exp(c[1:])]))
        s = np.bincount(rows, vals * w[cols], n) if len(rows) else np.zeros(n)
        upto = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), upto * (1 - upto), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(full[at, grades + 1] - full[at, grades], 1e-12)
        d_high, d_low = slope[at, grades + 1] / p, slope[at, grades] / p
        ds = (d_high - d_low) / n  # of the loss by the score
        gw = (np.bincount(cols, vals * ds[rows], n_cols) if len(rows) else np.zeros(n_cols)) + l2 * w
        g_cut = np.array([(d_low[grades == j + 1].sum() - d_high[grades == j].sum()) / n for j in range(k)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        gc = np.concatenate([tail[:1], tail[1:] * np.exp(c[1:])]) + np.concatenate([[0.0], 1e-3 * c[1:]])
        g = np.concatenate([gw, gc])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, c = w - move[:n_cols], c - move[n_cols:]
    return w, np.cumsum(np.concatenate([c[:1], np.exp(c[1:])]))


def sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled texts: of labelled ids those of
    least hash, and of texts that share an id the least.  A text counts once, as
    toxic if any of its labels says so."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def text_features(text: str | None) -> set[str]:
    """The words of a text, and the first letters of longer ones, marked by a star."""
    ws = set(WORD.findall((text or "").lower()))
    return ws | {w[:n] + "*" for w in ws for n in STEMS if len(w) > n}


def _counted(rows: DataFrame) -> DataFrame:
    """(word, n, t): texts that have each feature, and toxic ones, per slice of
    the sample; cut as in ``Model.features``."""

    def work(batches):
        for b in text_slices(batches, 0):
            n: Counter[str] = Counter()
            t: Counter[str] = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = text_features(text)
                n.update(found)
                if toxic > 0:
                    t.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([t[w] for w in n], pa.int64())], ["word", "n", "t"])

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(work, "word string, n bigint, t bigint")


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); one that calls
    nothing toxic where the sample has no toxic or no other text."""
    rows = common.stash(sample(docs, labels, bound), "labelled")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not toxic or toxic == total:
        return Model()
    seen = _counted(rows).groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("n") >= MIN_TEXTS)
    seen = common.stash(seen, "words")

    def part(a, b):  # a * log(a / b), zero at a = 0
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    T, N = float(toxic), float(total)
    ratio = 2 * (part(t, n * T / N) + part(n - t, n * (N - T) / N) + part(T - t, (N - n) * T / N) + part(N - n - (T - t), (N - n) * (N - T) / N))
    least = max(MIN_RATIO, 2 * math.log(max(1, seen.count())))
    picked = [r.word for r in seen.withColumn("r", ratio).filter((F.col("r") >= least) & (t / n > T / N)).orderBy(F.desc("r"), "word").limit(MAX_WORDS).collect()]
    model = Model({w: i for i, w in enumerate(picked)})

    def work(batches):
        for b in text_slices(batches, 0):
            x = [model.features(v) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(f) for f in x], pa.list_(pa.int32())), pa.array([list(f.values()) for f in x], pa.list_(pa.float64()))], ["toxic", "at", "value"])

    got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(work, "toxic int, at array<int>, value array<double>").toArrow()
    sizes = np.array([len(x) for x in got["at"].to_pylist()], np.int64)
    flat = lambda c, kind: np.fromiter((x for row in got[c].to_pylist() for x in row), kind)
    row_of, col, val, bad = np.repeat(np.arange(len(sizes)), sizes), flat("at", np.int64), flat("value", float), got["toxic"].to_numpy() > 0
    held = np.bincount(row_of, val, len(sizes))
    grades = np.where(bad, 1 + np.searchsorted(np.quantile(held[bad], [1 / 3, 2 / 3]), held, "left"), 0)
    model.weights, model.cuts = fit_ordinal(row_of, col, val, grades, len(picked))
    return model


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 .. 3), p_toxic, grade, rejected per row.

    Null and empty texts have no words and score as such; repeated rows score
    alike, null ids are kept; columns of other names are ignored; an empty table
    gives an empty result.
    """

    def work(batches):
        for b in text_slices(batches, 1):
            upto = model.at_most(model.score(b.column(1).to_pylist()))
            p = np.diff(np.concatenate([np.zeros((len(upto), 1)), upto, np.ones((len(upto), 1))], axis=1), axis=1)
            toxic = 1 - upto[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array((p * np.arange(GRADES)).sum(axis=1)), pa.array(toxic), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic >= REJECT_FROM)],
                ["doc_id", "expected_severity", "p_toxic", "grade", "rejected"],
            )

    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, columns unchanged; nothing
    is shuffled.  Null and empty texts stay; repeated rows go or stay together; an
    empty table gives an empty result."""
    names = docs.columns

    def work(batches):
        at = names.index(text_col)
        for b in text_slices(batches, at):
            toxic = 1 - model.at_most(model.score(b.column(at).to_pylist()))[:, 0]
            yield b.filter(pa.array(toxic < REJECT_FROM))

    return docs.mapInArrow(work, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return grade(docs, train(docs, common.table(spark, sf_dir, "labels")))
