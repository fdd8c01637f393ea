"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all other texts are unlabelled, toxic ones among them. With the class
prior p, the risk of a scorer g is p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)]): the second term is the
negative risk corrected for the toxic share, and it may not fall below zero (where it would, its gradient is
turned round). A linear scorer over hashed features is trained with it in numpy.

Features of a text: its distinct words (runs of letters, lower-cased) and their beginnings of four, five and seven
letters, hashed; those whose rate in positives is surely (by a standard error) above that in unlabelled texts
are kept, up to a bound, at every size of the sample. A text's sum of weights is evened by the root of its number of
features. A quarter of the sample is kept out of this training: on it, the cut is chosen that makes recall squared
over the share of texts found largest (a criterion that needs no negatives), and the bias is set so that
the cut scores `threshold`. If no positive falls into that quarter, the whole sample sets the cut.
Neither labels nor language, source or id are read when a text is scored.

Training uses a bounded sample, `most_positives` and `most_unlabelled` texts with the smallest hashed ids;
the feature counts of the sample are summed by Spark, and the driver gets the selected features of the
sample only (bounded by `most_features` and the sample). Scoring covers every row and whole texts.

Defined results: null and empty texts have no features and get the score of the bias alone. Without
positives all scores are 0 (below 1e-12). A row without an id is scored, is not held out and trains nothing.
Repeated rows are scored alike; several labels of one doc_id count as toxic if
one of them is. An empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .piece_memo import PieceMemo, held, joined

DIMENSIONS = 1 << 18
BEGINNINGS = (4, 5, 7)
_WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def feature_memo() -> PieceMemo:
    return held(("features",), _feature_memo)


def _feature_memo() -> PieceMemo:
    import xxhash

    def buckets(words: list[str]) -> tuple:
        return joined([[xxhash.xxh32_intdigest(x) % DIMENSIONS for x in {f"w{w}", *(f"{n}{w[:n]}" for n in BEGINNINGS)}] for w in words])

    return PieceMemo(buckets, 250_000)


def text_features(texts: list[str], memo: PieceMemo) -> list[np.ndarray]:
    """The distinct hashed features of each text."""
    memo.begin()
    numbers = [np.unique(memo.numbers(_WORD.findall(t.lower()))) for t in texts]
    memo.settle()
    return [np.unique(memo.ids(n)) for n in numbers]


def _features(df: DataFrame, what, schema: str) -> DataFrame:
    """df (…, text) by what(part, features), which gives rows of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = feature_memo()
        for pdf in batches:
            for a, b in slices(map(len, pdf["text"])):
                part = pdf.iloc[a:b]
                yield what(part, text_features(part["text"].tolist(), memo))

    return df.mapInPandas(run, schema)


def nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss. rows: feature places."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    of, at = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    for step in range(1, steps + 1):
        g = np.bincount(of, w[at], minlength=len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        soft = np.logaddexp(0, g)  # the loss of a negative
        negative_risk = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
        push = np.where(positive, -prior * s / n_p, s / n_u)
        up = np.where(positive, prior * (s - 1) / n_p, 0.0)
        slope = up + push if negative_risk >= 0 else -push
        grad = np.append(np.bincount(at, slope[of], minlength=n_features), slope.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most_positives: int = 4000, most_unlabelled: int = 12_000, most_features: int = 4096, least_ratio: float = 1.0, threshold: float = 0.7) -> tuple[np.ndarray, float]:
    """Weights by hashed feature, and the bias. docs: doc_id, text. Held-out rows are not used."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    weights = np.zeros(DIMENSIONS)
    if not n_toxic:
        return weights, -30.0
    prior = min(0.9, n_toxic / n)
    drawn = lambda df, most: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ours = docs.where(fold(F.col("doc_id")) != 1)
    positives = drawn(known.where("toxic = 1"), most_positives).withColumn("positive", F.lit(True))
    unlabelled = drawn(ours, most_unlabelled).withColumn("positive", F.lit(False))
    # at most most_positives + most_unlabelled ids, and one text of each: that of the smallest hash
    found = ours.join(F.broadcast(positives.union(unlabelled)), "doc_id")
    found = found.groupBy("doc_id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = found.select("positive", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("held"), "text")

    def count(part: pd.DataFrame, features: list[np.ndarray]) -> pd.DataFrame:
        flags, used = part["positive"].to_numpy(bool), ~part["held"].to_numpy(bool)
        groups = [[f for f, on in zip(features, used & (flags == side), strict=True) if on] for side in (True, False)]
        p, u = (np.bincount(np.concatenate([np.zeros(0, np.int64), *g]).astype(np.int64), minlength=DIMENSIONS) for g in groups)
        p[0], u[0] = map(len, groups)  # place 0 counts the texts
        hit = np.flatnonzero(p + u)
        return pd.DataFrame({"feature": hit, "p": p[hit], "u": u[hit]})

    counts = _features(sample, count, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = counts.where("feature = 0").agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
    p, u = F.col("p") + 0.5, F.col("u") + 2.0
    # the log ratio of the two rates, less its standard error: a feature seen a few times counts for less
    sure = F.log(p / u) - float(np.log((n_p + 0.5) / (n_u + 2.0))) - F.sqrt(1 / p + 1 / u)
    chosen = counts.where("p > 0 AND feature > 0").where(sure > least_ratio).orderBy(F.desc(F.col("p") * sure), "feature").limit(most_features)
    selected = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64))

    def pick(part: pd.DataFrame, features: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"positive": part["positive"], "held": part["held"], "n": list(map(len, features)), "places": [np.searchsorted(selected, f[np.isin(f, selected)]).astype(np.int32).tobytes() for f in features]})

    rows = _features(sample, pick, "positive boolean, held boolean, n long, places binary").collect()
    places = [np.frombuffer(r["places"], np.int32) for r in rows]
    positive, held = (np.array([r[c] for r in rows], bool) for c in ("positive", "held"))
    w, bias = nnpu([x for x, h in zip(places, held, strict=True) if not h], positive[~held], len(selected), prior)
    g = np.array([w[x].sum() for x in places]) * evened(np.array([r["n"] for r in rows]))
    judged = held if (held & positive).any() and (held & ~positive).any() else np.ones(len(held), bool)
    if (judged & ~positive).any():
        bias = np.log(threshold / (1 - threshold)) - cut(g[judged & positive], g[judged & ~positive], prior)
    weights[selected] = w
    return weights, float(bias)


def cut(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut with the largest recall squared over the share of unlabelled texts found, in the middle of
    the gap below it."""
    positives, unlabelled = np.sort(positives), np.sort(unlabelled)
    at = np.unique(positives)
    recall = 1 - np.searchsorted(positives, at) / len(positives)
    found = np.maximum(1 - np.searchsorted(unlabelled, at) / len(unlabelled), prior * recall)
    best = at[np.argmax(recall**2 / found)]
    below = unlabelled[unlabelled < best]
    return float((best + (below[-1] if len(below) else best)) / 2)


def evened(n_features: np.ndarray) -> np.ndarray:
    """What a weight sum is multiplied by: chance features add up in a long text as the root of its length."""
    return np.sqrt(400 / (n_features + 20))


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    weights = weights.astype(np.float32)

    def scored(part: pd.DataFrame, features: list[np.ndarray]) -> pd.DataFrame:
        g = np.array([weights[f].sum(dtype=np.float64) for f in features]) * evened(np.fromiter(map(len, features), np.int64, len(features))) + bias
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        return pd.DataFrame({"doc_id": part["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    # ids go as text: pandas would turn whole numbers with nulls among them into floats
    out = _features(docs.withColumn("doc_id", F.col("doc_id").cast("string")), scored, "doc_id string, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **train_args) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    weights, bias = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), threshold=threshold, **train_args)
    out = score(docs, weights, bias, threshold)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
