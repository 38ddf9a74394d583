"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. It is posted in the inverted files of its first pivots; a query
visits the files of its own first pivots. Within a file, candidates are ranked by the footrule distance of the two pivot
orders (places beyond the prefix count as the prefix length), the nearest of them are reranked by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import land

# The pivots are a bounded sample of the vectors; every vector is indexed.
MIN_PIVOTS, MAX_PIVOTS = 64, 4096
PIVOTS_PER_ROOT = 2.0
PREFIX = 64
POSTED = 16
RERANKED = 400
FILE_ROWS = 8_192  # vectors of one part of an inverted file


def usable(vector: Column) -> Column:
    """Not null, of finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, their lengths) of a list column of equal lengths."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(raw), -1) if len(raw) else flat.reshape(0, 1)
    # Scaled first, so that neither tiny nor huge components leave the range when squared.
    scale = np.abs(rows).max(axis=1, initial=0.0)
    return rows, scale * np.sqrt(((rows / np.where(scale > 0, scale, 1)[:, None]) ** 2).sum(axis=1))


def choose_pivots(vectors: DataFrame, vector: str, count: int, seed: int = 10) -> np.ndarray:
    """``count`` different vectors, chosen by a hash; at most MAX_PIVOTS rows reach the driver."""
    order = F.xxhash64(vector, F.lit(seed))
    rows = vectors.select(vector, order.alias("o")).dropDuplicates([vector]).orderBy("o").limit(count).select(vector).toArrow()
    values, lengths = unit_rows(rows.column(0))
    return values / lengths[:, None]


def permutations(vectors: DataFrame, vector: str, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """Add ``pivots``: the indexes of the nearest pivots, nearest first, ties to the smaller index."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    length = min(prefix, len(pivots))
    schema = vectors.withColumn("pivots", F.array(F.lit(0).cast("short"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = []
            for at in range(0, batch.num_rows, 1024):
                rows, lengths = unit_rows(batch.column(vector).slice(at, 1024))
                near = rows @ shared.value.T / lengths[:, None]
                top = np.argpartition(-near, length - 1, axis=1)[:, :length]
                top.sort(axis=1)
                orders.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
            flat = np.concatenate(orders).astype(np.int16) if orders else np.zeros((0, length), np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, length, dtype=np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "pivots"])

    return vectors.mapInArrow(run, schema)


def footrule(query: np.ndarray, candidates: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distances of one pivot order to many: sum over pivots of the difference of places."""
    length = len(query)
    place = np.full(pivots, length, np.int32)
    place[query] = np.arange(length)
    steps = np.arange(length, dtype=np.int32)
    at = place[candidates]
    # Pivots of a candidate: |own place - query's place|. Pivots of the query alone: length - query's place.
    missing = length * (length + 1) // 2 - np.where(at < length, length - at, 0).sum(axis=1)
    return np.abs(at - steps).sum(axis=1) + missing


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", reranked: int = RERANKED) -> DataFrame:
    """The ``k`` nearest found of every row that ``queries`` selects: ``query_id``, ``rank``, ``vec_id``, ``score`` (cosine).

    ``queries`` is a condition on ``vec_id`` (the key, as long) and ``v`` (the vector).
    Unusable vectors (null, zero, null or non-finite components) take no part, as queries and as candidates. A query is no
    candidate of itself. Rows that repeat a key count once (the first by its vector). Equal vectors are indexed and asked once,
    under their smallest id, and give their smallest ids at the end. A query with fewer than ``k`` candidates in its files is
    compared with all vectors, in blocks, so it gets all there are. Inverted files are cut into parts of a bounded number of
    rows, so a pivot to which a third of all vectors are close is dealt to many tasks.
    """
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    total = rows.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    # k others of a class besides the query itself are enough, and so are k + 1 classes, one of which may be the query alone.
    same = Window.partitionBy("v")
    members = rows.withColumn("n", F.row_number().over(same.orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = land(members.select(F.min("vec_id").over(same).alias("class_id"), "vec_id", "v"), "members")
    classes = members.filter("class_id = vec_id").select("vec_id", "v")
    asked = rows.filter(F.coalesce(queries, F.lit(False))).withColumnRenamed("vec_id", "query_id")
    asked = land(asked.join(classes.withColumnRenamed("vec_id", "class_id"), "v").select("query_id", "class_id"), "asked")
    count = min(classes.count(), MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(total))))
    pivots = choose_pivots(classes, "v", count)
    asking = asked.select(F.col("class_id").alias("vec_id"), F.lit(True).alias("is_query")).distinct()
    placed = classes.join(asking, "vec_id", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    placed = land(permutations(placed, "v", pivots), "permutations")
    posted = placed.select("vec_id", "v", "pivots", "is_query", F.explode(F.slice("pivots", 1, POSTED)).alias("file"))
    # Two counts per pivot: at most MAX_PIVOTS rows.
    query_parts = F.greatest(F.lit(1), F.ceil(F.count_if("is_query") / FILE_ROWS)).cast("int")
    parts = posted.groupBy("file").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("parts"), query_parts.alias("query_parts"))
    sized = posted.join(parts, "file")
    part, query_part = (F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int") for c in ("parts", "query_parts"))
    every_part, every_query_part = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "query_parts"))
    candidates = sized.select("file", part.alias("part"), every_query_part.alias("query_part"), "vec_id", "v", "pivots", F.lit(False).alias("asks"))
    asking = sized.filter("is_query").select("file", every_part.alias("part"), query_part.alias("query_part"), "vec_id", "v", "pivots", F.lit(True).alias("asks"))
    n_pivots = len(pivots)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids = frame["vec_id"].to_numpy()
        orders = np.stack(frame["pivots"].to_numpy())
        values = np.stack(frame["v"].to_numpy()).astype(np.float64)
        lengths = np.sqrt((values**2).sum(axis=1))
        own, own_orders, own_values, own_lengths = ids[~asks], orders[~asks], values[~asks], lengths[~asks]
        out = []
        for q in np.flatnonzero(asks):
            far = footrule(orders[q], own_orders, n_pivots)
            # All that tie with the last one reranked are reranked too.
            take = np.flatnonzero(far <= np.partition(far, reranked - 1)[reranked - 1]) if len(far) > reranked else np.arange(len(far))
            score = (own_values[take] * values[q]).sum(axis=1) / (own_lengths[take] * lengths[q])
            best = np.lexsort((own[take], -score))[: k + 1]
            out.append((np.full(len(best), ids[q]), own[take][best], score[best]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    found = candidates.unionByName(asking).groupBy("file", "part", "query_part").applyInPandas(compare, "query_id long, vec_id long, score double").distinct()
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = land(_expand(_first(found, k + 1), members, k), "found")
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    sized = asked.join(found, "class_id", "left").select("class_id", F.coalesce(F.size(others), F.lit(0)).alias("others"))
    short = land(sized.filter(F.col("others") < min(k, total - 1)).select(F.col("class_id").alias("vec_id")).distinct(), "short")
    if not short.isEmpty():
        full = _expand(_in_blocks(placed.join(short, "vec_id", "left_semi"), placed, k + 1), members, k)
        found = found.join(short.select(F.col("vec_id").alias("class_id")), "class_id", "left_anti").unionByName(full)
    listed = asked.join(found, "class_id").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return listed.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Per class that asked, ``class_id`` and ``near``: the first k + 1 (vec_id, score) of the members of the classes it found."""
    asked = found.select("query_id", F.col("vec_id").alias("class_id"), "score").join(members.select("class_id", "vec_id"), "class_id")
    near = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score")))
    return _first(asked, k + 1).groupBy(F.col("query_id").alias("class_id")).agg(near.alias("near"))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _in_blocks(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """All of ``rows`` against the few queries whose files held too little, blocks of rows against blocks of queries."""
    blocks = max(1, math.ceil(rows.count() / FILE_ROWS))
    query_blocks = max(1, math.ceil(queries.count() / 1024))
    left = queries.select("vec_id", "v", F.lit(True).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = rows.select("vec_id", "v", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ids, values = frame["vec_id"].to_numpy(), np.stack(frame["v"].to_numpy()).astype(np.float64)
        lengths = np.sqrt((values**2).sum(axis=1))
        own = np.flatnonzero(~asks)
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        for q in np.flatnonzero(asks):
            score = (values[own] * values[q]).sum(axis=1) / (lengths[own] * lengths[q])
            best = np.lexsort((ids[own], -score))[:k]
            out.append(pd.DataFrame({"query_id": ids[q], "vec_id": ids[own][best], "score": score[best]}))
        return pd.concat(out).astype({"query_id": "int64", "vec_id": "int64"})

    pairs = left.withColumn("q", F.col("q").cast("int")).unionByName(right).groupBy("q", "b").applyInPandas(compare, "query_id long, vec_id long, score double")
    return _first(pairs, k)
