"""Phrase collocations counted in a burstable hash trie.

A task keeps one trie of word ids. Its shallow nodes are indexed by language and leading words; below them counts lie in plain
hash containers. A container that grows too large bursts: words that fill much of it get a child of their own, the others stay
together. When the task holds too many entries, whole subtrees leave as sorted runs, largest first. The runs of all tasks meet
in ranges of the sorted phrases: a range is a set of prefixes, or a slice of one prefix that is too common for a single range.

Words and pairs are counted first. A phrase reaches a count only where all its pairs do, so the second pass counts phrases of
three and four words between the pairs that passed; a bit filter of bounded size carries them (a false hit costs a row, never an error).
"""

from __future__ import annotations

import itertools
import math
from collections import Counter as Counted
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.bpe import blocks
from marketflow.llm.common import land, mix64

LONGEST = 4
LEAST = 30
KEPT = 2000
ABSORBED = 80  # percent of a phrase's count that a longer one holding it must have
SCALE = 2_000_000  # 1,000,000 times the Dice coefficient
NO_LANGUAGE = "und"
WORD_BYTES = 4
BURST = 16_384  # entries of a container
SHARE = 64  # a word with more than 1 / SHARE of a bursting container gets a child
DEEPEST = 3  # levels of nodes: language, first and second word
HELD_ENTRIES = 900_000  # entries of a task's trie before subtrees leave
HELD_WORDS = 500_000  # words of a task's dictionary
BLOCK_BYTES = 3 << 20  # a block of short words takes about forty times its text while it is counted
MIN_BITS, MAX_BITS, BITS_PER_PAIR, PROBES = 1 << 16, 1 << 28, 16, 3
RUN_ROWS = 65_536

PIECE, WORD, LETTER = 2, 1, 0
KIND = np.zeros(256, np.uint8)
KIND[[ord(c) for c in " \t"]] = WORD
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = PIECE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
RUN_SCHEMA = "key string, f long"
RUN_TYPES = pa.schema([("key", pa.string()), ("f", pa.int64())])
AFTER_LANGUAGE = "\n"  # between language and phrase in a key; it cuts pieces, so no phrase holds it


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of whole texts (A-Z lower-cased), the text each stands in, and whether the next word continues its piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    kind = KIND[data]
    letter = kind == LETTER
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    starts[cuts] = letter[cuts]
    at = np.flatnonzero(starts)
    # Only letters stay; a word's bytes reach from its start to the next one's.
    before = np.cumsum(letter)
    ends = np.append(before[at] - 1, before[-1] if len(before) else 0)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.ascontiguousarray(ends.astype(np.int64))), pa.py_buffer(LOWER[data[letter]]))
    text = np.searchsorted(offsets, at, "right") - 1
    piece = np.cumsum(kind == PIECE)[at]
    linked = np.zeros(len(at), bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return words, text, linked


class Trie:
    """Counts of paths (language id, word ids): nodes while paths are shared by many, hash containers of the remaining ids below.

    A container's keys are the bytes of its 32-bit ids.
    """

    class Node:
        __slots__ = ("children", "rest")

        def __init__(self, rest: dict | None = None):
            self.children: dict[int, Trie.Node | dict] = {}
            self.rest: dict[bytes, int] = rest or {}

    def __init__(self):
        self.root = Trie.Node()
        self.entries = 0

    def add(self, paths: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of different paths, sorted; -1 fills the place after a path's end."""
        if len(paths):
            self._add(self.root, paths, counts, 0)

    def _add(self, node: Trie.Node, paths: np.ndarray, counts: np.ndarray, level: int) -> None:
        rest = np.ones(len(paths), bool)
        if node.children:
            lead = paths[:, level]
            edges = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1], True])
            for at, (a, b) in zip(lead[edges[:-1]].tolist(), itertools.pairwise(edges.tolist()), strict=True):
                child = node.children.get(at)
                if child is not None:
                    rest[a:b] = False
                    if isinstance(child, Trie.Node):
                        self._add(child, paths[a:b], counts[a:b], level + 1)
                    else:
                        node.children[at] = self._fill(child, paths[a:b, level + 1 :], counts[a:b], level + 1)
        if rest.any():
            grown = self._fill(node.rest, paths[rest, level:], counts[rest], level)
            if isinstance(grown, Trie.Node):
                node.rest = grown.rest
                node.children.update(grown.children)

    def _fill(self, table: dict, keys: np.ndarray, counts: np.ndarray, level: int) -> Trie.Node | dict:
        """Count into a container; the container, or the node it bursts into."""
        size, get = len(table), table.get
        packed = self._packed(keys)
        if size:
            table.update({key: get(key, 0) + n for key, n in zip(packed, counts.tolist(), strict=True)})
        else:
            table.update(zip(packed, counts.tolist(), strict=True))
        self.entries += len(table) - size
        # A container that found nothing to hand down is tried again only at twice the size.
        grown = (len(table) // BURST).bit_length() > (size // BURST).bit_length()
        return self._burst(table) if grown and level < DEEPEST else table

    @staticmethod
    def _burst(table: dict) -> Trie.Node | dict:
        keys = np.frombuffer(b"".join(table), np.int32).reshape(len(table), -1)
        words, where, sizes = np.unique(keys[:, 0], return_inverse=True, return_counts=True)
        heavy = sizes * SHARE > len(table)
        if not heavy.any():
            return table
        counts = np.fromiter(table.values(), np.int64, len(table))
        node = Trie.Node(Trie._container(keys[~heavy[where]], counts[~heavy[where]]))
        for word in np.flatnonzero(heavy):
            own = where == word
            node.children[int(words[word])] = Trie._container(keys[own, 1:], counts[own])
        return node

    @staticmethod
    def _container(keys: np.ndarray, counts: np.ndarray) -> dict[bytes, int]:
        return dict(zip(Trie._packed(keys), counts.tolist(), strict=True))

    @staticmethod
    def _packed(keys: np.ndarray) -> list[bytes]:
        return np.ascontiguousarray(keys).view(f"V{keys.shape[1] * WORD_BYTES}").ravel().tolist() if len(keys) else []

    def cut(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, largest first, until at most ``keep`` entries stay: (paths, counts) of each."""
        parts = []

        def collect(node: Trie.Node, prefix: tuple) -> None:
            parts.append((len(node.rest), node, None, prefix))
            for lead, child in node.children.items():
                if isinstance(child, Trie.Node):
                    collect(child, (*prefix, lead))
                else:
                    parts.append((len(child), node, lead, (*prefix, lead)))

        collect(self.root, ())
        for size, node, lead, prefix in sorted(parts, key=lambda p: -p[0]):
            if self.entries <= keep:
                break
            if not size:
                continue
            table = node.rest if lead is None else node.children[lead]
            if lead is None:
                node.rest = {}
            else:
                node.children[lead] = {}
            self.entries -= size
            keys = np.frombuffer(b"".join(table), np.int32).reshape(size, -1)
            paths = np.empty((size, len(prefix) + keys.shape[1]), np.int64)
            paths[:, : len(prefix)] = prefix
            paths[:, len(prefix) :] = keys
            yield paths, np.fromiter(table.values(), np.int64, size)
        if not self.entries:
            self.root = Trie.Node()


def pair_hash(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs from hashes of their language and words."""
    return mix64(lang + mix64(first + mix64(second)))


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(words) * 64
    found = np.ones(len(hashes), bool)
    for p in _probes(hashes, bits):
        found &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def pair_filter(pairs: DataFrame, count: int) -> np.ndarray:
    """Bits of the pairs ``(lang, phrase)``, 64 in a word; sized by their number, at most MAX_BITS (32 MB), whatever that is."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(max(1, count) * BITS_PER_PAIR))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = [_hash(v) for v in batch.column(0).to_pylist()]
            first, second = zip(*(map(_hash, p.split(" ")) for p in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            at = np.concatenate(_probes(pair_hash(*(np.array(h, np.uint64) for h in (lang, first, second))), bits))
            slots, where = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(mask, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(mask.view(np.int64))], ["slot", "mask"])

    found = pairs.select("lang", "phrase").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("slot").to_numpy()] = found.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return words


def _unique(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows and their counts. Three ids go into one long; longer rows number their heads first."""
    width = max(1, int(max(c.max(initial=0) for c in columns) + 2).bit_length())
    number, used, whole = columns[0] + 1, width, True
    for c in columns[1:]:
        if used + width > 63:
            whole = False
            number = np.unique(number, return_inverse=True)[1]
            used = max(1, len(number).bit_length())
        number, used = (number << width) | (c + 1), used + width
    if whole:  # nothing was numbered anew: the ids are in the key
        number, counts = np.unique(number, return_counts=True)
        shifts = np.arange(len(columns) - 1, -1, -1) * width
        return (((number[:, None] >> shifts) & ((1 << width) - 1)) - 1).astype(np.int32), counts
    _, at, counts = np.unique(number, return_index=True, return_counts=True)
    return np.stack([c[at] for c in columns], axis=1).astype(np.int32), counts


class Counter:
    """The trie of one task with its dictionary; turns blocks of texts into sorted runs of (lang, words, phrase, f)."""

    def __init__(self, shortest: int, longest: int, passed: np.ndarray | None):
        self.shortest, self.longest, self.passed = shortest, longest, passed
        self.trie, self.ids, self.names, self.hashes = Trie(), {}, [], np.zeros(0, np.uint64)
        self.totals: Counted = Counted()

    def number(self, names: list[str]) -> np.ndarray:
        ids = self.ids
        out = np.fromiter((ids.setdefault(n, len(ids)) for n in names), np.int64, len(names))
        new = [n for n, i in zip(names, out.tolist(), strict=True) if i >= len(self.names)]
        if new:
            fresh = list(dict.fromkeys(new))
            self.names += fresh
            if self.passed is not None:
                self.hashes = np.concatenate([self.hashes, np.array([_hash(n) for n in fresh], np.uint64)])
        return out

    def read(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, text, linked = split(batch.column("text"))
        coded = words.dictionary_encode()
        word = self.number(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        coded = pc.fill_null(batch.column("lang"), NO_LANGUAGE).dictionary_encode()
        lang = self.number(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)][text] if len(words) else word
        for at, n in zip(*np.unique(lang, return_counts=True), strict=True):
            self.totals[self.names[at]] += int(n)
        if self.passed is not None and len(word):
            pairs = pair_hash(self.hashes[lang[:-1]], self.hashes[word[:-1]], self.hashes[word[1:]])
            linked[:-1] &= in_filter(self.passed, pairs)
        columns, reach = [lang, word], np.ones(len(word), bool)
        for k in range(1, self.longest):
            reach[: len(word) - k] &= linked[k - 1 : len(word) - 1]
            reach[max(0, len(word) - k) :] = False
            later = np.full(len(word), -1, np.int64)
            later[: len(word) - k] = np.where(reach[: len(word) - k], word[k:], -1)
            columns.append(later)
        if self.shortest > 1:
            long = columns[self.shortest] >= 0
            columns = [c[long] for c in columns]
        self.trie.add(*_unique(columns))
        if self.trie.entries > HELD_ENTRIES or len(self.names) > HELD_WORDS:
            full = len(self.names) > HELD_WORDS
            yield from self.spill(0 if full else HELD_ENTRIES // 4)
            if full:
                self.ids, self.names, self.hashes = {}, [], np.zeros(0, np.uint64)

    def spill(self, keep: int = 0) -> Iterator[pa.RecordBatch]:
        if self.trie.entries <= keep:
            return
        names = pa.array(self.names, pa.large_string())
        order = pc.sort_indices(names).to_numpy()
        ranks = np.full(len(order) + 1, -1, np.int64)  # the last place is that of -1
        ranks[order] = np.arange(len(order))
        names = names.take(pa.array(order))
        for paths, counts in self.trie.cut(keep):
            yield from self._runs(ranks[paths], counts, names)

    def _runs(self, paths: np.ndarray, counts: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """For each length, the prefixes of the paths with the sums of the subtrees below them, sorted by language and words."""
        order = np.lexsort(paths.T[::-1])
        paths, counts = paths[order], counts[order]
        for k in range(self.shortest, self.longest + 1):
            has = paths[:, k] >= 0
            own, sums = paths[has, : k + 1], counts[has]
            if not len(own):
                continue
            edges = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
            own, sums = own[edges], np.add.reduceat(sums, edges)
            for at in range(0, len(own), RUN_ROWS):
                words = [names.take(pa.array(column)) for column in own[at : at + RUN_ROWS].T]
                phrase = pc.binary_join_element_wise(*words[1:], pa.scalar(" ", pa.large_string()))
                key = pc.binary_join_element_wise(words[0], phrase, pa.scalar(AFTER_LANGUAGE, pa.large_string()))
                yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(sums[at : at + RUN_ROWS])], schema=RUN_TYPES)

    def word_totals(self) -> pa.RecordBatch:
        """All words of each language, under the empty phrase."""
        keys = [lang + AFTER_LANGUAGE for lang in self.totals]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(self.totals.values(), pa.int64())], schema=RUN_TYPES)


def count_runs(docs: DataFrame, shortest: int, longest: int, passed: np.ndarray | None = None) -> DataFrame:
    """Sorted runs ``(key, f)`` of the phrases of ``shortest`` to ``longest`` words; a phrase may occur in many runs."""
    shared = docs.sparkSession.sparkContext.broadcast(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shortest, longest, shared.value)
        for block in chain.from_iterable(blocks(b, "text", BLOCK_BYTES) for b in batches):
            yield from counter.read(block)
        yield from counter.spill()
        yield counter.word_totals()

    return docs.mapInArrow(run, RUN_SCHEMA)


def merge_runs(runs: DataFrame, least: int) -> DataFrame:
    """``lang, words, phrase, f`` of at least ``least`` occurrences, and the words of each language under the empty phrase.

    Runs were counted before they meet, so a phrase has at most one row a run and no partition grows with the number of its occurrences.
    """
    merged = runs.repartition("key").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", AFTER_LANGUAGE, -1)
    words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ", -1)))
    lang = F.expr("left(key, length(key) - length(phrase) - 1)")
    kept = merged.withColumn("phrase", phrase).withColumn("words", words).filter((F.col("f") >= least) | (F.col("words") == 0))
    return kept.select(lang.alias("lang"), "words", "phrase", "f")


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases of one to four words with at least ``least`` occurrences: ``lang, words, phrase, f``; words per language: ``lang, n``)."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    short = land(merge_runs(count_runs(rows, 1, 2), least), "short-phrases")
    totals = short.filter("words = 0").select("lang", F.col("f").alias("n"))
    frequent, pairs = short.filter("words > 0"), short.filter("words = 2")
    count = pairs.count()
    if not count:
        return frequent, totals
    long = merge_runs(count_runs(rows, 3, LONGEST, pair_filter(pairs, count)), least).filter("words > 0")
    return frequent.unionByName(land(long, "long-phrases")), totals


def score(counts: DataFrame) -> DataFrame:
    """Candidates ``(lang, words, phrase, a, l, r, score)``: the lowest-scoring cut of each phrase of two words and more."""
    parts = F.split("phrase", " ", -1)
    cuts = counts.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(parts, 1, F.col("k")), " "), "tail": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words").cast("int")), " ")})
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # Decimals hold the products; the quotient is a long again, at most SCALE / 2.
    value = F.expr(f"(cast(f as decimal(20,0)) * cast({SCALE} as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", value)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "words", "phrase", F.col("f").alias("a")).agg(lowest).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def drop_absorbed(candidates: DataFrame, percent: int = ABSORBED) -> DataFrame:
    """Leave out candidates inside a longer one, dropped or not, that has at least ``percent`` of their count."""
    parts = F.split("phrase", " ", -1)
    longer = candidates.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words").cast("int") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - F.col("size") + 1)))
    inner = longer.select("lang", F.array_join(F.slice(parts, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    absorbed = F.coalesce(wide("longer", 100) >= wide("a", percent), F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~absorbed).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, kept: int = KEPT) -> DataFrame:
    """The ``kept`` strongest phrases of two to four words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Counts cover all whole texts. Null and empty texts hold no words; a null language is ``und`` (and shares it with a language
    of that name). Equal scores are ordered by ``a``, then by the bytes of the phrase. Repeated rows count as often as they occur.
    Other columns are left out. An empty table, and a language without a frequent phrase, give no rows.
    """
    counts, totals = count_phrases(docs, text, lang, least)
    counts = land(counts, "phrases")
    candidates = land(score(counts), "candidates")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = drop_absorbed(candidates).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= kept)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
