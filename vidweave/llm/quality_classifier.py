"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or abstain on a text. Expectation-maximisation estimates,
without true labels, how accurate each labeller's votes are, and the share of good texts; its posterior is
the soft label of a vote pattern. A linear scorer over hashed byte n-grams and text
shape is trained on soft labels and scores every text.

The votes of all rows enter: Spark counts the vote patterns (at most 3 ** labellers of them, whatever the
table), and EM runs on these counts. The scorer is trained in one task on a bounded sample, the `most_sample`
texts with the smallest hashed ids; the sample ids and the weights are the only data broadcast. Scoring covers
every row and whole texts.

Defined results: a null text counts as empty; on an empty text all labellers abstain and the scorer gives its
bias. Labellers abstain where a text is too short for them. If all votes agree, or the table is empty, EM
keeps its starting point. Rows without an id are voted and scored, but train nothing. Repeated rows are voted and scored alike. All columns but the named ones pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_memo import release

BUCKETS = 1 << 14
_WORD = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff'-]+[.,;:?]*(?!\S)")
SHAPES = ("symbols", "capitals", "repeats", "exclamations", "bars", "variety", "word_length", "sentences", "words")
LABELLERS = (*SHAPES, "plain", "prose")
BAD, GOOD, ABSTAIN = 0, 1, 2


def varieties(ws: list[bytes], width: int = 400) -> tuple[float, float]:
    """Mean and least share of distinct words over all windows of `width` words; a shorter text is one window."""
    n = len(ws)
    if n <= width:
        return (len(set(ws)) / max(1, n),) * 2
    last: dict[bytes, int] = {}
    before = np.empty(n, np.int64)
    for k, w in enumerate(ws):
        before[k] = last.get(w, -1)
        last[w] = k
    # word k is the first of its kind in the windows that begin after its last occurrence, up to k
    at, starts = np.arange(n), n - width + 1
    begin, end = np.maximum(before, at - width) + 1, np.minimum(at + 1, starts)
    real = begin < end
    distinct = np.cumsum(np.bincount(begin[real], minlength=starts + 1) - np.bincount(end[real], minlength=starts + 1))[:starts]
    return float(distinct.mean()) / width, float(distinct.min()) / width


def shape(text: str) -> dict[str, float]:
    """What the labellers look at, as shares."""
    raw = text.encode()
    ws = raw.split()
    n = max(1, len(ws))
    letters = len(raw) - len(raw.translate(None, bytes(range(65, 91)) + bytes(range(97, 123))))
    capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    grams = list(zip(ws, ws[1:], ws[2:], strict=False))
    variety, least_variety = varieties(ws)
    return {
        "n": len(ws),
        "symbols": (len(raw) - len(raw.translate(None, b"#*$%&<>"))) / n,
        "capitals": capitals / max(1, letters),
        "repeats": 1 - len(set(grams)) / max(1, len(grams)),
        "exclamations": raw.count(b"!!") / n,
        "bars": raw.count(b"|") / n,
        "variety": variety,
        "least_variety": least_variety,
        "word_length": sum(map(len, ws)) / n,
        "words": len(_WORD.findall(raw)) / n,
        "sentences": sum(w[-1:] in (b".", b"?", b"!") for w in ws) / n,
    }


def votes(x: dict[str, float]) -> list[int]:
    """One vote of each labeller."""
    if x["n"] == 0:
        return [ABSTAIN] * len(LABELLERS)
    bad = lambda found: BAD if found else ABSTAIN
    long, middle = x["n"] >= 40, x["n"] >= 15
    plain = x["symbols"] < 0.1 and x["capitals"] < 0.15 and x["repeats"] < 0.1 and x["exclamations"] < 0.01 and x["bars"] < 0.01
    return [
        bad(x["symbols"] > 0.6),
        bad(x["capitals"] > 0.5 and middle),
        bad(x["repeats"] > 0.5 and middle),
        bad(x["exclamations"] > 0.2),
        bad(x["bars"] > 0.2),
        bad(x["least_variety"] < 0.2 and long),
        bad(not 2 <= x["word_length"] <= 15 and middle),
        bad(x["sentences"] < 0.005 and long),
        bad(x["words"] < 0.7 and middle),
        GOOD if plain and middle else ABSTAIN,
        GOOD if 0.02 <= x["sentences"] <= 0.4 and x["variety"] > 0.3 and x["words"] > 0.85 and middle else ABSTAIN,
    ]


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, trust: float = 0.95) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of `good` by pattern, the labellers' accuracies, and the share of good texts.

    Labellers are taken as independent given the class; one's accuracy is the probability that its vote is
    right when it votes. Half as many votes as it has cast count as a prior, the share `trust` of them right."""
    votes_good, votes_bad = patterns == GOOD, patterns == BAD
    cast = ((votes_good | votes_bad) * counts[:, None]).sum(0)
    accuracy, share, posterior = np.full(patterns.shape[1], trust), 0.8, np.full(len(patterns), 0.5)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        log = np.log(share / (1 - share)) + votes_good @ weight - votes_bad @ weight
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        right = ((votes_good * new[:, None] + votes_bad * (1 - new)[:, None]) * counts[:, None]).sum(0)
        accuracy = np.clip((right + 0.5 * trust * cast + trust) / (1.5 * cast + 1), 0.05, 0.995)
        share = float(np.clip((new * counts).sum() / max(1, counts.sum()), 0.05, 0.95))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, accuracy, share


def features(text: str) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(places, values, shape): the hashed byte trigrams with their shares, which sum to 10 (less in a very short text), and a place for
    the coarse level of each shape share, with value 1."""
    x = shape(text)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    grams = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 13)
    count = np.bincount(grams.astype(np.int64), minlength=1 << 13)
    at = np.flatnonzero(count)
    level = [(1 << 13) + 32 * k + min(31, int(32 * min(1.0, x[name] if name != "word_length" else x[name] / 16))) for k, name in enumerate(SHAPES)] if x["n"] >= 15 else []
    return np.concatenate([at, level]).astype(np.int64), np.concatenate([count[at] * (10 / max(100, len(grams))), np.ones(len(level))]), x


def fit_linear(rows: Iterable[tuple[np.ndarray, np.ndarray, float]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3, block: int = 256) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of (places, values, soft target), by Adam over all rows. Rows are taken and worked on
    by the block, and places kept as 16 bits, so beside the rows themselves little memory is used."""
    blocks, targets, rows = [], [], iter(rows)
    while part := list(islice(rows, block)):
        blocks.append((np.repeat(np.arange(len(part)), [len(a) for a, _, _ in part]).astype(np.uint16), np.concatenate([a for a, _, _ in part]).astype(np.uint16), np.concatenate([v for _, v, _ in part])))
        targets.append(np.array([t for _, _, t in part]))
    n = sum(map(len, targets))
    w, m, s = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):
        grad = np.zeros(BUCKETS + 1)
        for (of, at, value), target in zip(blocks, targets, strict=True):
            g = np.bincount(of, w[at] * value, minlength=len(target)) + w[-1]
            slope = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - target) / n
            grad[:-1] += np.bincount(at, slope[of] * value, minlength=BUCKETS)
            grad[-1] += slope.sum()
        grad[:-1] += decay * w[:-1] / len(w)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _code(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def _texts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def train(docs: DataFrame, most_sample: int = 4000) -> tuple[np.ndarray, float, dict[int, float]]:
    """Weights, bias, and the posterior of each vote pattern. docs: doc_id, text."""

    def pattern(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            yield pd.DataFrame({"pattern": [_code(votes(shape(t))) for t in pdf["text"]]})

    found = docs.select("text").mapInPandas(pattern, "pattern int").groupBy("pattern").count().collect()
    if not found:
        return np.zeros(BUCKETS), 0.0, {}
    codes = np.array([r["pattern"] for r in found])
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior, _, _ = em(patterns, np.array([r["count"] for r in found], float))
    soft = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_sample)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        rows = map(features, pdf.sort_values(["doc_id", "text"])["text"])
        w, bias = fit_linear((a, v, soft.get(_code(votes(x)), 0.5)) for a, v, x in rows)
        return pd.DataFrame({"w": [w.astype("<f8").tobytes()], "bias": [bias]})

    sample = docs.join(F.broadcast(ids.where("doc_id IS NOT NULL").distinct()), "doc_id")
    model = sample.groupBy(F.lit(1).alias("all")).applyInPandas(fit, "w binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS), 0.0, soft
    return np.frombuffer(bytes(model["w"]), "<f8"), model["bias"], soft


def classify(df: DataFrame, threshold: float = 0.5, most_sample: int = 4000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, posterior (of the votes), score (of the linear scorer) and kept (score >= threshold)."""
    docs = _texts(df, text_col, id_col)
    w, bias, soft = train(docs, most_sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                at, value, x = features(text)
                s = 1 / (1 + np.exp(-np.clip(float((w[at] * value).sum()) + bias, -30, 30)))
                rows.append((doc_id, soft.get(_code(votes(x)), 0.5), s, bool(s >= threshold)))
            yield pd.DataFrame(rows, columns=["doc_id", "posterior", "score", "kept"])

    # ids go as text: pandas would turn whole numbers with nulls among them into floats
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, posterior double, score double, kept boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def kept_rows(df: DataFrame, threshold: float = 0.5, most_sample: int = 4000) -> DataFrame:
    """The rows of df (with doc_id and text) that the scorer keeps, with df's columns; no row is shuffled."""
    w, bias, _ = train(_texts(df, "text", "doc_id"), most_sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scored = [features(t or "") for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([bool(float((w[at] * value).sum()) + bias >= np.log(threshold / (1 - threshold))) for at, value, _ in scored], pa.bool_()))

    return df.mapInArrow(run, df.schema)
