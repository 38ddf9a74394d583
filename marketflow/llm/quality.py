"""Quality classifier from weak labels: overlapping heuristics vote, expectation-maximisation weighs them, a scorer learns the rest.

1. Heuristic labellers vote good (1), bad (-1) or abstain (0) on every text.
2. Expectation-maximisation over the table of vote patterns (bounded by 3 to the number of labellers) estimates the share of
   good documents and each labeller's accuracy on good and on bad ones.
3. The posterior labels of a bounded sample train a logistic scorer over hashed features; it also judges texts on which the
   labellers are silent or split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import mix64

LABELLERS = ("symbols", "shouting", "exclaiming", "variety", "repeated_lines", "word_length", "sentences", "plain")
SAMPLE = 6_000  # documents on whose posterior labels the scorer is fitted
BUCKETS = 1 << 14
EPOCHS = 30
KEEP = 0.5
FALSE_ALARM = 0.01  # most a labeller may call good documents bad
LEAST_ALARM = 0.05  # least a labeller calls bad documents bad, so that rare kinds count

_ODD = re.compile(r"[#$%&*@^~|<>{}\[\]\\+=]")


def shape(text: str) -> dict[str, float]:
    """Shares over the whole text, which is not blank."""
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    count = len(words)
    signs = len(_ODD.findall(text))
    return {
        "count": count,
        "signs": signs,
        "odd": signs / len(text),
        "upper": sum([w.isupper() and len(w) > 1 for w in words]) / count,
        "bangs": text.count("!") / count,
        "ends": (text.count(".") + text.count("?")) / count,
        "distinct": len(set(words)) / count,
        "lines": len(lines),
        "repeats": 1 - len(set(lines)) / len(lines),
        "mean": sum(map(len, words)) / count,
    }


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """One vote per labeller: the first six call a text bad or abstain, the last two call it good or abstain.

    The least share of different words falls with a text's length, as vocabularies grow more slowly than texts.
    """
    alarms = (
        -1 if s["odd"] > 0.05 and s["signs"] > 2 else 0,
        -1 if s["upper"] > 0.25 and s["count"] > 4 else 0,
        -1 if s["bangs"] > 0.15 and s["count"] > 4 else 0,
        -1 if s["count"] >= 12 and s["distinct"] < min(0.3, 3 * s["count"] ** -0.4) else 0,
        -1 if s["lines"] > 3 and s["repeats"] > 0.5 else 0,
        -1 if s["mean"] > 25 or s["mean"] < 1.5 else 0,
    )
    calm = (s["odd"] < 0.01 or s["signs"] <= 2) and s["upper"] < 0.08 and s["bangs"] < 0.05
    return (*alarms, 1 if 0.02 < s["ends"] < 0.5 else 0, 1 if calm and not any(alarms) else 0)


def features(text: str, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) pairs of a text: hashed runs of one to three characters by class, and its shares in steps.

    Letters count as ``a`` or ``A`` and digits as ``0``, so the features see form, not vocabulary, and hold for any language.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _KINDS[data].astype(np.int64)
    pairs = kinds[1:] * _N + kinds[:-1]
    counts = np.bincount(np.concatenate([kinds, pairs + _N, pairs[1:] * _N + kinds[:-2] + _N + _N * _N]), minlength=_N + _N**2 + _N**3)
    grams = np.flatnonzero(counts)
    steps = [int(10 * min(1.0, s[name])) + 16 * i for i, name in enumerate(("distinct", "repeats", "upper", "bangs", "odd"))]
    longer = s["count"] >= 12  # the share of different words means little for short texts
    steps = np.array(steps if longer else steps[1:]) + (1 << 20)
    values = np.concatenate([np.sqrt(counts[grams] / len(data)), np.full(len(steps), 0.5)])
    return (mix64(np.concatenate([grams, steps]).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64), values


# Classes of bytes: lower-case letters and all bytes beyond ASCII, capitals, digits, white space, controls, and each sign.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_N = 5 + len(_SIGNS)
_KINDS = np.full(256, 4, np.uint8)
_KINDS[[b for b in range(256) if b >= 128 or chr(b).islower()]] = 0
_KINDS[ord("A") : ord("Z") + 1], _KINDS[ord("0") : ord("9") + 1] = 1, 2
_KINDS[[9, 10, 11, 12, 13, 32]] = 3
_KINDS[_SIGNS] = np.arange(5, _N)


def pattern_code(vote: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(vote))


def decode_patterns(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**i % 3 - 1 for i in range(len(LABELLERS))], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and table[label, labeller, vote + 1] of vote probabilities given the label (0 bad, 1 good).

    Starts from labellers that speak rightly thirteen times in fourteen, which fixes which of the two labels is the good one.
    Each kind of bad text alarms another labeller, so two labels alone would split by the most frequent kind; that an alarm is
    rarely false (FALSE_ALARM) makes every kind bad. Counts are smoothed by one, so that no probability is zero.
    """
    share = 0.8
    table = np.empty((2, patterns.shape[1], 3))
    table[1], table[0] = np.array([0.05, 0.3, 0.65]), np.array([0.65, 0.3, 0.05])
    for _ in range(rounds):
        good = posterior(patterns, share, table)
        weights = np.stack([counts * (1 - good), counts * good])
        new = np.stack([[[(w * (patterns[:, j] == v)).sum() + 1 for v in (-1, 0, 1)] for j in range(patterns.shape[1])] for w in weights])
        table = new / new.sum(axis=2, keepdims=True)
        table[1, :, 0] = np.minimum(table[1, :, 0], FALSE_ALARM)
        table[0, :6, 0] = np.maximum(table[0, :6, 0], LEAST_ALARM)
        table /= table.sum(axis=2, keepdims=True)
        old, share = share, float((weights[1].sum() + 1) / (counts.sum() + 2))
        if abs(share - old) < 1e-9:
            break
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of good per vote pattern; labellers count as independent given the label."""
    each = np.arange(patterns.shape[1])
    logs = [np.log(p) + np.log(table[label, each, patterns + 1]).sum(axis=1) for label, p in ((0, 1 - share), (1, share))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _voted(docs: DataFrame, text: str) -> DataFrame:
    """``code``, the vote pattern of every row; null for blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pattern_code(votes(shape(t))) if t and not t.isspace() else None for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], ["code"])

    return docs.select(text).mapInArrow(run, "code int")


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, seed: int = 3) -> dict:
    """Labeller table and scorer weights. All documents vote; at most ``sample`` of them (half per weak label) train the scorer.

    What reaches the driver is the table of vote patterns and the sample's features, both bounded.
    """
    held = _voted(docs, text).groupBy("code").count().toPandas().dropna()
    codes, counts = held["code"].to_numpy(np.int64), held["count"].to_numpy(float)
    if not len(codes):
        return {"codes": codes, "good": np.zeros(0), "share": 1.0, "table": None, "weights": np.zeros(BUCKETS + 1)}
    patterns = decode_patterns(codes)
    share, table = estimate(patterns, counts)
    good = posterior(patterns, share, table)
    # Sampling rates by weak label, so that a rare label is learned as well; the sample is one of hashes of texts.
    rates = {label: min(1.0, 0.5 * sample / max(1.0, (counts * (good > 0.5 if label else good <= 0.5)).sum())) for label in (0, 1)}
    known = dict(zip(codes.tolist(), good.tolist(), strict=True))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # No rate is above both, so most texts are passed over without a vote.
                if not t or t.isspace() or u >= max(rates.values()):
                    continue
                form = shape(t)
                p = known[pattern_code(votes(form))]
                if u < rates[int(p > 0.5)]:
                    buckets, values = features(t, form)
                    rows.append((p, buckets.tolist(), values.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["p", "buckets", "vals"]
            )

    unit = (F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    picked = docs.select(text, unit).mapInArrow(chosen, "p double, buckets array<long>, vals array<double>")
    # Copies of one text share its hash; the cut is by rows, in the order of a hash of the features.
    frame = picked.orderBy(F.xxhash64("buckets", "vals")).limit(2 * sample).toPandas()
    return {"codes": codes, "good": good, "share": share, "table": table, "weights": train(frame)}


def train(frame: pd.DataFrame) -> np.ndarray:
    """Logistic regression on soft labels by full-batch steps of adaptive size; the last weight is the bias."""
    weights = np.zeros(BUCKETS + 1)
    if not len(frame):
        return weights
    sizes = frame["buckets"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(frame)), sizes)
    buckets = np.concatenate(frame["buckets"].to_numpy()).astype(np.int64)
    values = np.concatenate(frame["vals"].to_numpy())
    target = frame["p"].to_numpy()
    memory = np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS * 10):
        score = np.bincount(rows, values * weights[buckets], len(frame)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.bincount(buckets, values * error[rows], BUCKETS) / len(frame) + 1e-5 * weights[:-1]
        slope = np.append(slope, error.mean())
        memory += slope**2
        weights -= 0.5 * slope / np.sqrt(memory)
    return weights


def score(docs: DataFrame, model: dict, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Add ``quality_score`` (0 to 1), ``weak_label`` (posterior of the votes) and ``keep`` to ``docs``; one scan, no shuffle.

    Null, empty and blank texts have score 0, no weak label and are not kept. Input columns of those names are replaced.
    """
    rest = docs.drop("quality_score", "weak_label", "keep")
    known = dict(zip(model["codes"].tolist(), model["good"].tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], known, model["share"], model["table"]))
    schema = rest.withColumns({"quality_score": F.lit(0.0), "weak_label": F.lit(None).cast("double"), "keep": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, share, table = shared.value
        for batch in batches:
            scores, weak = [], []
            for t in batch.column(text).to_pylist():
                if not t or t.isspace():
                    scores.append(0.0)
                    weak.append(None)
                    continue
                form = shape(t)
                vote = votes(form)
                p = known.get(pattern_code(vote))
                if p is None:  # a pattern that was not seen when the model was fitted
                    p = float(posterior(np.array([vote]), share, table)[0]) if table is not None else 0.5
                buckets, values = features(t, form)
                scores.append(float(1 / (1 + np.exp(-np.clip((values * weights[buckets]).sum() + weights[-1], -30, 30)))))
                weak.append(p)
            kept = [w is not None and s >= keep for s, w in zip(scores, weak, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(weak, pa.float64()), pa.array(kept, pa.bool_())], [*batch.schema.names, "quality_score", "weak_label", "keep"])

    return rest.mapInArrow(run, schema)


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``score`` with a model fitted on ``docs`` itself."""
    return score(docs, fit(docs, text), text)
