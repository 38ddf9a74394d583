"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two random permutations of ``0..UNIVERSE-1`` give all signature coordinates: the first scatters a document's shingle hashes, the
second, circularly shifted by k, gives coordinate k. For one shingle the coordinates are therefore one contiguous slice of the
second permutation, and a signature is the minimum over such slices.

Links between different texts are found by banding, and every link is confirmed on full shingle sets. A bucket's members are not
compared pair by pair on their texts: each is compared with the bucket's hub, the member that shares most buckets. What remains of
a member is its difference from the hub; two members' sets differ by exactly the symmetric difference of their differences, so
all their links follow from these small sets, through an inverted index over the differing shingles, without emitting a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import components, land, mix64

UNIVERSE = 1 << 20
COORDINATES = 128
BLOCK_SHINGLES, BLOCK_MEMBERS = 4_000_000, 20_000  # of one side of a comparison task within a hub's group
SEED = 20
# Odd multiplier of the polynomial hash over bytes, and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 4096  # shingles whose slices are in memory at once: 2 MB


def band_rows(threshold: float, coordinates: int = COORDINATES) -> int:
    """Most rows per band with which a pair at the threshold is missed with probability of at most one in a million."""
    fitting = [r for r in range(1, 17) if (1 - threshold**r) ** (coordinates // r) <= 1e-6]
    return max(fitting, default=1)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word n-grams, sorted.

    A-Z are lower-cased; words are maximal runs of other characters than ASCII white space. With fewer than ``n`` words the
    whole sequence is one shingle; without words, or for a null text, there is none. The hash covers the words joined by single
    spaces, so equal shingles have equal hashes wherever they stand.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = len(data)
    # Prefix sums of byte * base**position; a substring's difference, divided by base**start, does not depend on its place.
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix64(data.astype(np.uint64) + np.uint64(1)) * power)])
    k = max(1, len(words) - n + 1)
    first, last = starts[:k], ends[n - 1 :] if len(words) >= n else ends[-1:]
    return np.unique(mix64((prefix[last] - prefix[first]) * back[first] + (last - first).astype(np.uint64)))


class Permutations:
    def __init__(self, coordinates: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(UNIVERSE).astype(np.int64)
        shifted = rng.permutation(UNIVERSE).astype(np.uint32)
        # Slices that run over the end continue at the beginning.
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([shifted, shifted[: coordinates - 1]]), coordinates)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.scatter[(hashes % np.uint64(UNIVERSE)).astype(np.int64)]
        parts = [self.slices[places[i : i + _BLOCK]].min(axis=0) for i in range(0, len(places), _BLOCK)]
        return np.minimum.reduce(parts)


def signatures(docs: DataFrame, n: int, threshold: float, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``node`` (128-bit digest of the set, null without shingles) and ``bands``."""
    import hashlib

    rows = band_rows(threshold, coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = Permutations(coordinates)
        count = coordinates // rows
        salt = mix64(np.arange(1, count + 1, dtype=np.uint64))
        weights = mix64(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, n)
                sizes.append(len(hashes))
                if not len(hashes):
                    nodes.append(None)
                    bands.append(None)
                    continue
                nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                table = permutations.signature(hashes)[: count * rows].astype(np.uint64).reshape(count, rows)
                bands.append(mix64((mix64(table + np.uint64(1)) * weights).sum(axis=1) ^ salt).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "node", "bands"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>")


def differences(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Every pair (``hub``, ``node``) compared on full sets: ``size``, ``linked`` and ``delta``, the shingles of only one of both.

    ``linked``: 100 * intersection >= percent * union. ``delta`` is kept where the hub has several members (``several``).
    A task holds a batch of pairs of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            sizes, linked, deltas = [], [], []
            for hub, several, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("hub", "several", "text_a", "text_b")), strict=True):
                if hub != last:
                    last, left = hub, shingle_hashes(text_a, n)
                right = shingle_hashes(text_b, n)
                delta = np.setxor1d(left, right, assume_unique=True)
                total = len(left) + len(right)
                sizes.append(len(right))
                linked.append(100 * (total - len(delta)) >= percent * (total + len(delta)))
                deltas.append(delta.tobytes() if several else None)
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node"), pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(deltas, pa.binary())], ["hub", "node", "size", "linked", "delta"])

    second = pairs.join(texts.select("node", F.col("text").alias("text_b")), "node")
    both = second.join(texts.select(F.col("node").alias("hub"), F.col("text").alias("text_a")), "hub")
    return both.select("hub", "node", "several", "text_a", "text_b").mapInArrow(run, "hub binary, node binary, size long, linked boolean, delta binary")


def _link_block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges among one hub's members: of the unlinked on one side to all on the other, as a forest (a node and its part's head)."""
    asks = frame["asks"].to_numpy()
    nodes, index = np.unique(frame["node"].to_numpy(), return_inverse=True)
    deltas = [np.frombuffer(d, np.uint64) for d in frame["delta"]]
    sizes = frame["size"].to_numpy()
    # Part 0 is the hub's; the others start as their own.
    part = np.arange(1, len(nodes) + 1)
    part[index[frame["linked"].to_numpy()]] = 0
    rows = np.flatnonzero(~asks)
    lengths = np.array([len(deltas[r]) for r in rows], np.int64)
    shingles = np.concatenate([deltas[r] for r in rows]) if len(rows) else np.zeros(0, np.uint64)
    order = np.argsort(shingles, kind="stable")
    shingles, owners = shingles[order], np.repeat(np.arange(len(rows)), lengths)[order]
    for x in np.flatnonzero(asks):
        low, high = np.searchsorted(shingles, deltas[x], "left"), np.searchsorted(shingles, deltas[x], "right")
        counts = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        common = np.bincount(owners[places], minlength=len(rows))
        apart = len(deltas[x]) + lengths - 2 * common
        total = sizes[x] + sizes[rows]
        near = np.flatnonzero(100 * (total - apart) >= percent * (total + apart))
        parts = np.unique(np.append(part[index[rows[near]]], part[index[x]]))
        if len(parts) > 1:
            part[np.isin(part, parts)] = parts[0]
    moved = np.flatnonzero((part != np.arange(1, len(nodes) + 1)) & ~np.isin(np.arange(len(nodes)), index[frame["linked"].to_numpy()]))
    heads = [frame["hub"].iloc[0] if part[i] == 0 else nodes[part[i] - 1] for i in moved]
    # A part joined to the hub's through a linked member is headed by the hub.
    return pd.DataFrame({"a": nodes[moved], "b": heads})


def bucket_links(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes of ``members(node, bucket)`` linked within a bucket, and no others."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("members"))
    degrees = members.join(sizes, "bucket").groupBy("node").agg(F.sum("members").alias("degree"))
    placed = members.join(degrees, "node")
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    pairs = members.join(hubs, "bucket").filter("node <> hub").select("hub", "node").distinct()
    counted = pairs.groupBy("hub").agg((F.count("*") > 1).alias("several"))
    found = land(differences(pairs.join(counted, "hub"), texts, n, percent), "differences")
    edges = found.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    groups = found.filter("delta is not null").groupBy("hub").agg(F.count("*").alias("rows"), F.sum(F.length("delta") / 8).alias("shingles"), F.count_if(~F.col("linked")).alias("left"))
    parts = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_MEMBERS)).cast("int")
    groups = groups.filter("left > 0 and rows > 1").select("hub", parts.alias("parts"))
    dealt = found.join(groups, "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = ["hub", "node", "size", "linked", "delta"]
    asking = dealt.filter("not linked").select(*columns, F.col("own").alias("i"), other.alias("j"), F.lit(True).alias("asks"))
    asked = dealt.select(*columns, other.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _link_block(frame, percent)

    within = asking.unionByName(asked).groupBy("hub", "i", "j").applyInPandas(compare, "a binary, b binary")
    return edges.union(within)


def _classes(docs: DataFrame, n: int, percent: int, coordinates: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, one row per node with its first ``doc_id`` and ``text_hash`` and its ``component``)."""
    found = land(signatures(docs, n, percent / 100, coordinates), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    classes = found.filter("node is not null").groupBy("node").agg(first.alias("rep"), F.first("bands").alias("bands"))
    classes = land(classes.select("node", "rep.doc_id", "rep.text_hash", "bands"), "classes")
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = land(members.join(shared, "bucket"), "buckets")
    needed = members.select("node").distinct().join(classes.select("node", "doc_id", "text_hash"), "node")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    match = keyed["doc_id"].eqNullSafe(needed["doc_id"]) & (keyed["text_hash"] == needed["text_hash"])
    texts = land(keyed.join(needed, match).select("node", "text").dropDuplicates(["node"]), "texts")
    labels = components(bucket_links(members, texts, n, percent))
    named = classes.select("node", "doc_id", "text_hash").join(labels, "node", "left")
    return found, named.select("node", "doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def link(docs: DataFrame, n: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked doc_id) and ``kept``.

    Only ``doc_id`` and ``text`` are read. Null and empty texts have no shingles and link with nothing. Documents with equal
    sets are one node however many they are. Rows that repeat a doc_id each give a row; a null doc_id links and is never
    smallest. An empty table gives an empty result.
    """
    found, named = _classes(docs, n, percent, coordinates)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id")
    out = found.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each group of linked texts one row stays, whatever ids its rows have.

    It is one with the smallest doc_id, null last, and of these the one with the smallest text hash. Texts that are not linked
    all stay, also under one doc_id or under null. Documents without text are no copies of one another: rows that repeat both
    doc_id and text are reduced to one, those with a null doc_id all stay.
    """
    _, named = _classes(docs.select("doc_id", "text"), n, percent, COORDINATES)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("rep"))
    kept = first.select(F.col("rep.doc_id").alias("_kept"), F.col("rep.text_hash").alias("_hash"))
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    # The white space that separates words; a text of nothing else has no shingle.
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    same = keyed["doc_id"].eqNullSafe(kept["_kept"]) & (keyed["_text_hash"] == kept["_hash"])
    copies = keyed.filter(worded).join(kept, same, "left_semi").unionByName(keyed.filter(~worded & F.col("doc_id").isNotNull()))
    return copies.dropDuplicates(["doc_id", "_text_hash"]).unionByName(keyed.filter(~worded & F.col("doc_id").isNull())).drop("_text_hash")
