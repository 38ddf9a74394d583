"""Helpers the operators of this package share: tables, landed intermediates, tokenizer files and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.session import checkpoint, ensure_checkpoint_dir

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder of the cluster (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def land(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; the package that holds the files is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def mix64(x):
    """A bijective mixer of unsigned 64-bit numpy values (shift-multiply rounds)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row per node with an edge, ``node`` and ``component`` (smallest node).

    Rounds of neighbour minimum and pointer jumping, each cut by a checkpoint in the shared folder. Aggregates combine before
    the shuffle and joins are skew-split, so a hub with a third of all edges is dealt to many tasks. No edge, node or label is
    collected. An empty input gives an empty result; self-loops give a component of one node; null ends are ignored.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    both = checkpoint(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        moved = checkpoint(step.join(up, "mid").select("node", "old", F.least("mid", "top").alias("component")))
        changed = moved.filter("component < old").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
