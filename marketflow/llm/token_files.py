"""Token files: documents' token ids as Parquet list columns, ordered by document, for selective reads of tokens or metadata.

One row per document: ``doc_id``, ``n_tokens``, ``shard`` (range partition), ``shard_start`` (tokens before it in its shard) and
``tokens`` (list of int). The writer controls what a reader can skip:

* ``tokens`` is dictionary-encoded (a page holds 16-bit codes for a vocabulary of up to 65,536 ids); its dictionary page is
  sized for the whole vocabulary, so that it never falls back to plain values;
* the sorted integer columns are delta-encoded (Parquet writer version 2, no dictionary);
* row groups have a byte bound, pages a byte and row bound; column and offset indexes are written with every file, so that a
  filter on ``doc_id`` reads only the pages of those documents, and a query without ``tokens`` reads none of them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketflow.llm import bpe
from marketflow.llm.common import tokenizer_file

END_ID = 1
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
DICTIONARY_BYTES = 1 << 20
TEXT_ROWS_PER_SHARD = 20_000
BLOCK_BYTES = 16 << 20  # text a task encodes at once
WORDS_AT_ONCE = 1_000  # pre-tokens in one call of the library
FILE_SCHEMA = "doc_id long, n_tokens long, shard int, shard_start long, tokens array<int>"


class LibraryEncoder(bpe.Blocks):
    """Whole texts by the tokenizers library; each distinct pre-token of a block is encoded once.

    The model encodes each pre-token alone, so that the ids of a text are those of its parts in order.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        super().__init__(bpe.WordPieces(path))
        whole = self.split.tokenizer
        self.model = Tokenizer(whole.model)
        self.ends = np.array([(whole.id_to_token(i) or "").endswith(bpe.END_OF_WORD) for i in range(whole.get_vocab_size())])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pre-tokens go to the library at once; a word ends where a token with the end-of-word suffix stands."""
        parts = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        found = [np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(parts, is_pretokenized=True, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int64), *found])
        return ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> LibraryEncoder:
    """The encoder of this worker process."""
    return LibraryEncoder(path)


def encode(docs: DataFrame, shards: int, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows of the token files, range-partitioned and sorted by ``doc_id``.

    Only ``doc_id`` and ``text`` are read. Texts are encoded whole; a null or empty text is the end id alone. Null ids come
    first. Rows that share a doc_id are ordered by a hash of their text, then by the text; the hash is part of the range key,
    so one id with a third of all rows still spreads over shards.
    """
    path = path or tokenizer_file(bpe.WORD_BPE)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    ordered = keyed.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    names = ["doc_id", "n_tokens", "shard", "shard_start", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_of(path), 0
        for batch in chain.from_iterable(bpe.blocks(b, "text", BLOCK_BYTES) for b in batches):
            ends, ids = encoder.encode_block(batch.column("text"))
            ids = np.insert(ids.view("<i4"), ends[1:], end_id)
            offsets = ends + np.arange(len(ends))
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), batch.column("shard"), pa.array(before + offsets[:-1]), tokens], names)
            before += int(offsets[-1])

    return ordered.mapInArrow(run, FILE_SCHEMA)


def write(docs: DataFrame, folder: str, shards: int | None = None, path: str | None = None, end_id: int = END_ID) -> None:
    """Write token files in ascending ``doc_id`` order: file by file, and within each file.

    ``shards`` defaults to one per 20,000 documents, at least the shuffle partitions of the session. An empty table gives
    files without rows. Extra columns of ``docs`` are not carried, whatever their names.
    """
    spark = docs.sparkSession
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TEXT_ROWS_PER_SHARD))
    rows = encode(docs, shards, path, end_id)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def shard_starts(files: DataFrame) -> DataFrame:
    """Tokens before each shard: ``shard``, ``before``; one row per file, from the metadata columns alone."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def metadata(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before it) and ``n_tokens``, without reading a token page."""
    return files.select("doc_id", "shard", "shard_start", "n_tokens").join(shard_starts(files), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens")


def checksums(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            offsets = tokens.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(tokens.values.to_numpy(), "<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kept = [batch.column(c) for c in ("doc_id", "shard", "shard_start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    read_back = files.select("doc_id", "shard", "shard_start", "tokens").mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return read_back.join(shard_starts(files), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
