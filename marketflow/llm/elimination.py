"""Exact top-k inner products by elimination over a pivot table.

Every vector's distances to the pivots are computed once and stored. For a query q and a candidate x the largest
``|d(q, p) - d(x, p)|`` over the pivots p bounds d(q, x) from below, and since ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2`` it bounds the
score from above (the origin is the first pivot, which by itself gives |q||x|). Candidates are evaluated in the order of their bounds until the next bound lies
below the k-th score found: nothing beyond can enter the answer. The same bound over the ranges of a block of rows spares a
query whole blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import land
from marketflow.llm.vectors import EXACT, finite, products, scaled

SCALE = 256
PIVOTS = 64
SAMPLE = 2048  # vectors the pivots are chosen from
BLOCK_ROWS = 4096
PAGE_BLOCKS = 1024  # block summaries compared with a part of the queries at once
PART_QUERIES = 1024
SLAB = 16  # pivots looked at between two eliminations
FIRST_LOOK = 128
SINGLE = 2.0**24  # integers up to here are exact in single precision
LOOSE = 1e-6  # distances are stored in single precision; bounds are loosened by far more than its error
SCORES = "query_row long, query_id long, vec_id long, high decimal(38,0), low decimal(38,0)"
SCORE_SCHEMA = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])
LIMB = 1 << 64


def choose_pivots(vectors: DataFrame, vector: str, width: int, count: int = PIVOTS, scale: int = SCALE) -> np.ndarray:
    """The origin and ``count`` - 1 vectors far from each other, each the farthest of a sample from those before it.

    The sample is at most SAMPLE different vectors, by a hash.
    """
    order = F.xxhash64(vector, F.lit(11))
    rows = vectors.select(vector, order.alias("o")).dropDuplicates([vector]).orderBy("o").limit(SAMPLE).select(vector).toArrow()
    sample = scaled(rows.column(0), scale, width)
    chosen = [np.zeros(width)]
    nearest = (sample**2).sum(axis=1)
    while len(chosen) < count and nearest.max(initial=0) > 0:
        chosen.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row to each pivot, in single precision."""
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def _single(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = raw.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(raw), -1) if len(raw) else flat.reshape(0, 1)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


class Block:
    """Rows of one block with their part of the table, laid out pivot by pivot; integers in the narrowest type that keeps sums exact."""

    def __init__(self, x: np.ndarray, far: np.ndarray, ids: np.ndarray):
        self.x, self.far, self.ids = x, np.ascontiguousarray(far.T), ids
        self.norms = self.far[0].astype(np.float64) ** 2
        self.largest, self.farthest = float(np.abs(x).max(initial=0)), float(far.max(initial=0))
        self.single = x.astype(np.float32) if self.largest < SINGLE else x

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bound = self.largest * float(np.abs(q).max()) * len(q)
        if bound >= EXACT:
            return products(q[None, :], self.x[rows])[0]
        x, q = (self.single, q.astype(np.float32)) if bound < SINGLE else (self.x, q)
        # One pass over the block in place costs less than gathering a good part of its rows.
        found = (x @ q)[rows] if len(rows) * 4 > len(x) else x[rows] @ q
        return found.astype(np.int64)

    def answer(self, q: np.ndarray, q_far: np.ndarray, skip: int, k: int, least: float = -math.inf) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) for one query, ties to the smaller id, and how many rows were evaluated.

        Rows of id ``skip`` are no candidates. ``least`` is a score the k-th answer is known to reach; rows below it may be left out.
        """
        top = self.farthest + float(q_far.max())
        spare = LOOSE * top * top
        norms, far = self.norms + float(q_far[0]) ** 2, self.far
        alive, low = None, np.zeros(far.shape[1], np.float32)
        for at in range(0, len(q_far), SLAB):
            gap = np.empty_like(low)
            for p in range(at, min(at + SLAB, len(q_far))):
                np.subtract(far[p] if alive is None else far[p][alive], q_far[p], out=gap)
                np.maximum(low, np.abs(gap, out=gap), out=low)
            bound = (norms - np.maximum(low - np.float32(LOOSE * top), 0).astype(np.float64) ** 2) / 2 + spare
            keep = bound >= least
            # Compacting costs a gather per pivot: worth it once a good part is out.
            if keep.sum() * 4 < len(keep) * 3:
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                low, norms, bound = low[keep], norms[keep], bound[keep]
                if not len(alive):
                    return [], 0
        order = np.argsort(-bound)
        rows = order if alive is None else alive[order]
        bound = bound[order]
        fit = (bound >= least) & (self.ids[rows] != skip)
        rows, bound = rows[fit], bound[fit]
        best: list[tuple[int, int]] = []
        done, look = 0, FIRST_LOOK
        while done < len(rows):
            if len(best) == k and bound[done] < best[-1][0]:
                break
            if len(best) == k:
                look = min(look, int(np.searchsorted(-bound[done:], -best[-1][0], "right")))
            take = rows[done : done + look]
            scores = self.scores(q, take)
            near = scores >= best[-1][0] if len(best) == k else np.ones(len(take), bool)
            best = sorted([*best, *zip(scores[near].tolist(), self.ids[take[near]].tolist(), strict=True)], key=lambda s: (-s[0], s[1]))[:k]
            done, look = done + len(take), look * 4
        return best, done


def _answers(found: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.Table:
    rows = [(row, query, i, *divmod(int(s), LIMB)) for row, query, best in found for s, i in best]
    cut = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in cut[:3]), *(pa.array(map(Decimal, c), pa.decimal128(38, 0)) for c in cut[3:])], schema=SCORE_SCHEMA)


def pivot_table(vectors: DataFrame, pivots: np.ndarray, blocks: int, scale: int = SCALE) -> DataFrame:
    """``vectors(row, vec_id, v, asks)`` with ``far`` (distances to the pivots) and ``block``: rows close to the same pivot, at like
    distances, lie in one block. Blocks are ranges of (nearest pivot, distance, row), so copies of one vector spread over many."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    width = pivots.shape[1]

    def measured(full: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(scaled(batch.column("v"), scale, width), shared.value)
                if full:
                    yield pa.RecordBatch.from_arrays([*batch.columns, _single(far)], [*batch.schema.names, "far"])
                else:
                    near = far[:, 1:].argmin(axis=1) + 1 if far.shape[1] > 1 else np.zeros(len(far), np.int64)
                    own = far[np.arange(len(far)), near]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(own)], [*batch.schema.names, "near", "own"])

        return run

    fields = "row long, vec_id long, v array<double>, asks boolean"
    dealt = vectors.mapInArrow(measured(False), f"{fields}, near int, own float").repartitionByRange(blocks, "near", "own", "row")
    dealt = dealt.select("row", "vec_id", "v", "asks", F.spark_partition_id().alias("block"))
    return land(dealt.mapInArrow(measured(True), f"{fields}, block int, far array<float>"), "pivot-table")


def _route(spark_queries: DataFrame, table: DataFrame, pivots: int, scale: int, width: int) -> DataFrame:
    """Each query with every other block that may hold one of its answers: bounds over the ranges of a block's distances."""
    ranges = [F.array(*(f(F.col("far")[i]) for i in range(pivots))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    summaries = land(table.groupBy("block").agg(*ranges), "ranges")
    pages = max(1, math.ceil(summaries.count() / PAGE_BLOCKS))
    parts = max(1, math.ceil(spark_queries.count() / PART_QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = spark_queries.select(deal("row", parts).alias("part"), every(pages).alias("page"), "*")
    right = summaries.select(every(parts).alias("part"), deal("block", pages).alias("page"), "*")
    schema = pa.schema([("block", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("far", pa.list_(pa.float32())), ("least", pa.float64())])

    def reach(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return schema.empty_table()
        low, high = _matrix(blocks.column("low")), _matrix(blocks.column("high"))
        (names,), out = _columns(blocks, "block"), []
        far, own, least = _matrix(asked.column("far")), asked.column("block").to_numpy(), pc.fill_null(asked.column("least"), -math.inf).to_numpy()
        for i in range(asked.num_rows):
            top = high.max(axis=1) + far[i].max()
            gap = np.maximum(np.maximum(low - far[i], far[i] - high).max(axis=1) - LOOSE * top, 0)
            bound = (far[i, 0] ** 2 + high[:, 0] ** 2 - gap**2) / 2 + LOOSE * top * top
            out.append(names[(bound >= least[i]) & (names != own[i])])
        rows = asked.take(pa.array(np.repeat(np.arange(len(out)), [len(o) for o in out])))
        return pa.Table.from_arrays([pa.array(np.concatenate(out).astype(np.int32)), *(rows.column(n) for n in schema.names[1:])], schema=schema)

    ddl = "block int, row long, vec_id long, v array<double>, far array<float>, least double"
    return left.groupBy("part", "page").cogroup(right.groupBy("part", "page")).applyInArrow(reach, ddl)


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` largest inner products of floor(scale * component) for every row that ``queries`` selects, exactly:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller ``vec_id``.

    ``queries`` is a condition on the key column. Every row is a candidate but those of the query's own key. Null and empty
    vectors, those with null, non-finite or (scaled) too large components, and rows without a key take no part. Rows that
    repeat a key are candidates each; a key that asks with several rows gets the k best of all their pairs. Vectors of different
    lengths meet as if padded with zeros. A score that no long holds is null, at its right rank. With fewer than ``k``
    candidates a query gets them all. Other columns are left out. An empty table gives no rows.

    A query is first answered in its own block, which gives it a score to reach; then it visits only blocks whose bound reaches
    that score. Blocks and the queries of a block are cut to a bounded size. Where the bounds eliminate nothing (vectors spread
    evenly in many dimensions) all blocks are visited: that is the worst case of any exact search.
    """
    result = "query_id long, rank int, vec_id long, score long"
    asks = F.coalesce(queries, F.lit(False)).alias("asks")
    rows = vectors.filter(finite(F.col(vector), scale) & F.col(key).isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), asks)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], result)
    points = choose_pivots(rows, "v", width, pivots, scale)
    table = pivot_table(rows, points, math.ceil(n / block_rows), scale)

    def own_block(block: pa.Table) -> pa.Table:
        ids, lines, asking = _columns(block, "vec_id", "row", "asks")
        x, far = scaled(block.column("v"), scale, width), _matrix(block.column("far"), np.float32)
        held = Block(x, far, ids)
        return _answers([(int(lines[q]), int(ids[q]), held.answer(x[q], far[q], ids[q], k)[0]) for q in np.flatnonzero(asking)])

    first = land(table.groupBy("block").applyInArrow(own_block, SCORES), "first")
    # The k-th score found so far, in double precision, a little below where it is rounded.
    value = F.col("high").cast("double") * float(LIMB) + F.col("low").cast("double")
    order = Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    reached = first.withColumn("at", F.row_number().over(order)).filter(F.col("at") == k).select(F.col("query_row").alias("row"), (value - F.abs(value) * 1e-12).alias("least"))
    asked = table.filter("asks").join(reached, "row", "left").select("row", "vec_id", "v", "far", "block", "least")
    routed = land(_route(asked, table, len(points), scale, width), "routed")
    sizes = routed.groupBy("block").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("parts"))
    right = routed.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")
    left = table.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "far")

    def visit(block: pa.Table, asking: pa.Table) -> pa.Table:
        if not asking.num_rows or not block.num_rows:
            return SCORE_SCHEMA.empty_table()
        (ids,), (lines, names) = _columns(block, "vec_id"), _columns(asking, "row", "vec_id")
        held = Block(scaled(block.column("v"), scale, width), _matrix(block.column("far"), np.float32), ids)
        q, q_far, least = scaled(asking.column("v"), scale, width), _matrix(asking.column("far"), np.float32), pc.fill_null(asking.column("least"), -math.inf).to_numpy()
        return _answers([(int(lines[i]), int(names[i]), held.answer(q[i], q_far[i], names[i], k, least[i])[0]) for i in range(len(q))])

    more = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(visit, SCORES)
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    found = first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    half = F.lit(str(LIMB // 2)).cast("decimal(38,0)")
    low = F.when(F.col("low") >= half, F.col("low") - F.lit(str(LIMB)).cast("decimal(38,0)")).otherwise(F.col("low"))
    fits = F.col("high") == F.when(F.col("low") >= half, F.lit(-1)).otherwise(F.lit(0))
    return found.select("query_id", "rank", "vec_id", F.when(fits, low.cast("long")).alias("score"))
