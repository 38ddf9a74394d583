"""Near-duplicate vectors by a forest of random-projection trees with spill, compared within leaves, verified and united.

Each tree splits space again and again at the median projection on a random direction; vectors within a margin of the border go
to both sides, so a close pair is rarely separated by one tree and practically never by all. The trees' directions and borders
come from a bounded sample; every vector is placed. Within a leaf all pairs of a label are compared by cosine in double
precision, in blocks of a bounded size. No pair is emitted: a block gives each vector's number of links, counted only in the
first leaf a pair shares, and one edge per vector to the smallest vector of its component within the block, so that no link of
a block is lost to the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import components, land
from marketflow.llm.pivots import unit_rows, usable

TREES = 6
# Half the margin that spills, for unit vectors. A pair at cosine 0.98 is 0.2 apart; its projections on a random direction
# of 64 dimensions differ by 0.025 in root mean square, so that one border separates it with a chance of some thousandths.
SPILL = 0.03
LEAF_ROWS = 1_000  # wanted rows of one label in a leaf
SAMPLE_PER_LEAF = 16
MAX_SAMPLE = 131_072  # rows that reach the driver to fit the trees: at most 64 MB at 64 dimensions
BLOCK_ROWS = 2_048


class Tree:
    """A complete binary tree: per inner node (heap order) a direction and a border."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        inner = (1 << depth) - 1
        self.directions = np.zeros((inner, sample.shape[1]))
        self.borders = np.zeros(inner)
        rows: list[np.ndarray] = [np.arange(len(sample))] + [np.zeros(0, int)] * (2 * inner)
        for node in range(inner):
            own = rows[node]
            direction = rng.standard_normal(sample.shape[1])
            if len(own) > 1:
                # The difference of two of its vectors, which follows the spread of the node's vectors.
                a, b = rng.choice(own, 2, replace=False)
                if np.any(sample[a] != sample[b]):
                    direction = sample[a] - sample[b]
            direction /= np.sqrt((direction**2).sum())
            along = sample[own] @ direction
            border = float(np.median(along)) if len(own) else 0.0
            self.directions[node], self.borders[node] = direction, border
            rows[2 * node + 1], rows[2 * node + 2] = own[along <= border], own[along > border]

    def leaves(self, units: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all placements; a row near borders has several."""
        rows, nodes = np.arange(len(units)), np.zeros(len(units), np.int64)
        for _ in range(self.depth):
            along = np.einsum("ij,ij->i", units[rows], self.directions[nodes]) - self.borders[nodes]
            left, right = along <= spill, along > -spill
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes


def fit(vectors: DataFrame, vector: str, depth: int, trees: int, seed: int = 4) -> list[Tree]:
    """Trees over a sample of SAMPLE_PER_LEAF rows per leaf, at most MAX_SAMPLE, chosen by a hash of the vector."""
    rows = vectors.select(vector).dropDuplicates([vector]).orderBy(F.xxhash64(vector, F.lit(seed))).limit(min(MAX_SAMPLE, SAMPLE_PER_LEAF << depth)).toArrow()
    values, lengths = unit_rows(rows.column(0))
    rng = np.random.default_rng(seed)
    return [Tree(values / lengths[:, None], depth, rng) for _ in range(trees)]


def place(vectors: DataFrame, vector: str, forest: list[Tree], spill: float = SPILL) -> DataFrame:
    """Add ``leaves``: sorted ids of all leaves of all trees the vector falls into (tree in the high bits)."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)
    schema = vectors.withColumn("leaves", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = unit_rows(batch.column(vector))
            units = values / lengths[:, None]
            found = [tree.leaves(units, spill) for tree in shared.value]
            rows = np.concatenate([r for r, _ in found])
            ids = np.concatenate([leaf + (np.int64(t) << 40) for t, (_, leaf) in enumerate(found)])
            order = np.lexsort((ids, rows))
            offsets = np.searchsorted(rows[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], [*batch.schema.names, "leaves"])

    return vectors.mapInArrow(run, schema)


def _earlier(leaves: list[np.ndarray], leaf: int) -> np.ndarray:
    """Indicator rows of the leaves before ``leaf`` that two or more of the vectors share."""
    before = [x[x < leaf] for x in leaves]
    ids, counts = np.unique(np.concatenate(before), return_counts=True) if before else (np.zeros(0, np.int64), np.zeros(0, int))
    ids = ids[counts > 1]
    out = np.zeros((len(leaves), len(ids)), np.float32)
    for i, x in enumerate(before):
        at = np.searchsorted(ids, x)
        at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == x)] if len(ids) else at[:0]
        out[i, at] = 1
    return out


def _heads(close: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of links the first row of its component; each row's links are read once."""
    heads = np.full(len(close), -1)
    for first in range(len(close)):
        if heads[first] >= 0:
            continue
        heads[first] = first
        reached = np.array([first])
        while len(reached):
            reached = np.flatnonzero(close[reached].any(axis=0) & (heads < 0))
            heads[reached] = first
    return heads


def compare_block(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among a block's vectors: per vector ``n`` (weighted links whose first shared leaf this is) and ``low``, the smallest
    vector it reaches by links of the block.

    ``side`` 0 and 1 mark the two blocks of a pair of blocks, only crossing pairs of which count; one block alone has side 0.
    """
    none = pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})
    if len(frame) < 2:
        return none
    frame = frame.sort_values("vec_id", kind="stable")
    values = np.stack(frame["v"].to_numpy())
    # Scaled by the largest component, so that squares neither vanish nor overflow.
    values = values / np.abs(values).max(axis=1)[:, None]
    lengths = np.sqrt((values**2).sum(axis=1))
    sides = frame["side"].to_numpy()
    close = values @ values.T / (lengths[:, None] * lengths[None, :]) >= threshold
    close &= sides[:, None] != sides[None, :] if sides.any() else ~np.eye(len(frame), dtype=bool)
    some = np.flatnonzero(close.any(axis=1))
    if not len(some):
        return none
    close = close[np.ix_(some, some)]
    leaves = [np.asarray(x, np.int64) for x in frame["leaves"].to_numpy()[some]]
    before = _earlier(leaves, int(frame["leaf"].iloc[0]))
    fresh = close & ~(before @ before.T > 0) if before.shape[1] else close
    weights = frame["copies"].to_numpy()[some]
    ids = frame["vec_id"].to_numpy()[some]
    return pd.DataFrame({"vec_id": ids, "n": fresh @ weights, "low": ids[_heads(close)]})


def link(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", trees: int = TREES) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id`` (smallest id reachable) and ``kept``.

    Vectors link when their labels are equal and not null and their cosine is at least ``threshold``. Null and zero vectors, and
    those with null or non-finite components, link with nothing. Equal vectors of a label are compared once, whatever their
    number, and counted by it. A repeated key stands for one vector per different value; its row counts the links of all of
    them. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    good = rows.filter(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).distinct()
    # The smallest id stands for all copies.
    classes = land(good.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, most) / LEAF_ROWS)))
    depth = min(depth, int(math.log2(MAX_SAMPLE / SAMPLE_PER_LEAF)))
    # Several vectors may share an id; the comparison goes by a number of its own.
    placed = place(classes.withColumnRenamed("vec_id", "first_id").withColumn("vec_id", F.xxhash64("label", "v")), "v", fit(classes, "v", depth, trees) if most else [])
    placed = land(placed, "placed")
    posted = placed.select("label", F.explode("leaves").alias("leaf"), "vec_id", "v", "copies", "leaves")
    sizes = posted.groupBy("label", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).filter("blocks > 0")
    dealt = posted.join(sizes, ["label", "leaf"]).withColumn("own", F.pmod(F.col("vec_id"), F.col("blocks")).cast("int"))
    # A leaf of several blocks is compared pair of blocks by pair of blocks; a row goes to each pair its block is in.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("label", "leaf", low.alias("i"), high.alias("j"), (F.col("own") != low).cast("int").alias("side"), "vec_id", "v", "copies", "leaves")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return compare_block(frame, threshold)

    found = land(dealt.groupBy("label", "leaf", "i", "j").applyInPandas(compare, "vec_id long, n long, low long"), "links")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classified = placed.select("label", "v", "vec_id", "first_id", "copies").join(counts, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    classified = classified.withColumn("component", F.coalesce("component", "vec_id"))
    smallest = classified.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classified.join(smallest, "component").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "v"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
