"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Token counts are summed per cell (source, language, topic). Raking multiplies cell weights until the weighted token shares meet
the target of every source, language and topic, or all that a scarce one holds; a document is then kept with its cell's probability, by a hash of its id and
text, so that the same document gets the same decision on any cluster.

Names without a target share the group ``OTHER`` of their marginal, so the cells number at most the product of the target lists'
lengths plus one, whatever the table holds: a proven bound on what the driver fits and the tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
GROUPS = ["source_group", "lang_group", "topic"]
ROUNDS = 500
TOLERANCE = 1e-10
SEED = 7
# Fixed marginals of the production mix, as shares of all sampled tokens.
SOURCES = {"src0": 0.20, "src1": 0.06, "src2": 0.06, OTHER: 0.68}
LANGUAGES = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.12, OTHER: 0.01}
TOPICS = {"legal": 0.06, "contact": 0.02, "web": 0.02, OTHER: 0.90}
# Share of all tokens that the sample should hold.
BUDGET = 0.5
TOKEN = r"\S+"


def topic_of(text: Column) -> Column:
    """Topic by marks in the whole text, the first that fits: license lines, addresses, links; else ``OTHER``."""
    return (
        F.when(text.rlike(r"(?i)\b(?:licen[sc]ed?|copyright|all rights reserved)\b"), "legal")
        .when(text.rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "contact")
        .when(text.rlike(r"https?://"), "web")
        .otherwise(OTHER)
    )


def grouped(name: Column, targets: Iterable[str]) -> Column:
    """``name`` if it has a target, else ``OTHER``; null is ``OTHER``."""
    return F.when(name.isin([t for t in targets if t != OTHER]), name).otherwise(F.lit(OTHER))


def attainable(held: np.ndarray, target: np.ndarray, room: float) -> np.ndarray:
    """Tokens wanted per value: ``target * room``, at most what the value holds; what scarce values lack is shared over the others."""
    wanted, free = np.zeros(len(target)), (target > 0) & (held > 0)
    while free.any():
        left = max(0.0, room - wanted[~free].sum())
        wanted[free] = target[free] / target[free].sum() * left
        scarce = free & (wanted > held)
        if not scarce.any():
            break
        wanted[scarce] = held[scarce]
        free &= ~scarce
    return wanted


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], budget: float) -> tuple[np.ndarray, float]:
    """(probability per cell, tokens sampled): ``members[m][cell]`` is the cell's place in marginal m of shares ``targets[m]``.

    Proportional fitting of the sampled tokens ``tokens * p`` to every marginal in turn, with p at most one. The tokens sampled
    are ``budget`` (a share of all tokens), less only if the places with a share hold less. A place that holds less than its
    share gives all it has, and its shortfall is shared over the other places of its marginal. Stops when all hold to within
    TOLERANCE, or after ROUNDS (marginals that contradict each other; then the last one is met best and all cells are raised
    to fill the budget).
    """
    allowed = np.ones(len(tokens), bool)
    for place, target in zip(members, targets, strict=True):
        allowed &= target[place] > 0
    usable = np.where(allowed, tokens, 0.0)
    room = min(budget * tokens.sum(), usable.sum())
    wanted = [attainable(np.bincount(place, usable, len(target)), target, room) for place, target in zip(members, targets, strict=True)]
    p = np.where(allowed, min(1.0, room / max(1.0, usable.sum())), 0.0)
    for _ in range(ROUNDS):
        worst = 0.0
        for place, want in zip(members, wanted, strict=True):
            mass = np.bincount(place, tokens * p, len(want))
            worst = max(worst, float(np.abs(mass - want).max()) / max(1.0, room))
            p = np.minimum(1.0, p * np.where(mass > 0, want / np.where(mass > 0, mass, 1), 0)[place])
        if worst < TOLERANCE:
            break
    # Every turn fills the budget or brings one more cell to one.
    for _ in range(len(p)):
        short, free = room - tokens @ p, (p > 0) & (p < 1)
        if short <= TOLERANCE * room or not (tokens * p)[free].sum() > 0:
            break
        p[free] = np.minimum(1.0, p[free] * (1 + short / (tokens * p)[free].sum()))
    return p, room


def _fitted(placed: DataFrame, budget: float, marginals: list[dict[str, float]]) -> tuple[pd.DataFrame, list[np.ndarray], float]:
    """(cells with ``tokens`` and ``probability``, their places in each marginal, tokens sampled)."""
    cells = placed.groupBy(*GROUPS).agg(F.sum("n_words").alias("tokens")).orderBy(*GROUPS).toPandas()
    members = [cells[c].map({t: i for i, t in enumerate(m)}).to_numpy(dtype=float) for c, m in zip(GROUPS, marginals, strict=True)]
    # A marginal that names no OTHER gives unnamed values no share.
    lists = [np.append(np.array(list(m.values()), float), 0.0) for m in marginals]
    members = [np.where(np.isnan(p), len(t) - 1, p).astype(int) for p, t in zip(members, lists, strict=True)]
    cells["probability"], room = rake(cells["tokens"].to_numpy(float), members, lists, budget)
    return cells, members, room


def _placed(docs: DataFrame, sources: dict[str, float], languages: dict[str, float], topics: dict[str, float], text: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")
    return docs.drop(*GROUPS, "n_words", "probability", "sampled").withColumns({
        "source_group": grouped(F.col("source"), sources),
        "lang_group": grouped(F.col("lang"), languages),
        "topic": grouped(topic_of(F.coalesce(F.col(text), F.lit(""))), topics),
        "n_words": words,
    })


def report(docs: DataFrame, budget: float = BUDGET, sources: dict[str, float] = SOURCES, languages: dict[str, float] = LANGUAGES, topics: dict[str, float] = TOPICS, text: str = "text") -> pd.DataFrame:
    """Per marginal and value: ``tokens`` held, ``wanted`` by its target, ``expected`` in the sample, and ``shortfall``."""
    marginals = [sources, languages, topics]
    cells, members, room = _fitted(_placed(docs, sources, languages, topics, text), budget, marginals)
    out = []
    for name, place, targets in zip(GROUPS, members, marginals, strict=True):
        held = np.bincount(place, cells["tokens"].to_numpy(float), len(targets) + 1)
        expected = np.bincount(place, (cells["tokens"] * cells["probability"]).to_numpy(float), len(targets) + 1)
        out += [(name, t, held[i], share * room, expected[i], max(0.0, share * room - expected[i])) for i, (t, share) in enumerate(targets.items())]
    return pd.DataFrame(out, columns=["marginal", "value", "tokens", "wanted", "expected", "shortfall"])


def weigh(docs: DataFrame, budget: float = BUDGET, sources: dict[str, float] = SOURCES, languages: dict[str, float] = LANGUAGES, topics: dict[str, float] = TOPICS, text: str = "text") -> DataFrame:
    """Add ``source_group``, ``lang_group``, ``topic``, ``n_words``, ``probability`` and ``sampled`` to ``docs``.

    Tokens are runs of other characters than white space over whole texts; a null or empty text has none, and goes with the
    probability of its cell. Rows that repeat a document repeat its decision. Input columns of the added names are replaced.
    The table is scanned twice; only cell sums are shuffled. An empty table gives an empty result.
    """
    placed = _placed(docs, sources, languages, topics, text)
    cells, _, _ = _fitted(placed, budget, [sources, languages, topics])
    spark = docs.sparkSession
    rows = [tuple(r) for r in cells[[*GROUPS, "probability"]].itertuples(index=False)]
    table = spark.createDataFrame(rows, "source_group string, lang_group string, topic string, probability double")
    unit = F.pmod(F.xxhash64("doc_id", text, F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return placed.join(F.broadcast(table), GROUPS, "left").withColumn("sampled", unit < F.coalesce("probability", F.lit(0.0)))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows of ``docs``, with its columns alone."""
    return weigh(docs, **settings).filter("sampled").select(*docs.columns)
