"""Language identification by unigram models over pieces of a fixed public vocabulary, summed over all segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities; the forward algorithm sums them position by position. Piece probabilities are estimated per language by
expectation-maximisation on a bounded sample of labelled texts. Different words of a batch are scored once, all languages at
a time, in numpy; a text's score is the sum over its words, and all of its words count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import land, mix64, tokenizer_file

PIECES = "piece_bpe_32k.model"
LONGEST = 8  # characters of a piece; longer pieces of the vocabulary are left out
SAMPLE = 12_000  # labelled texts the model is fitted on
LEAST = 300  # texts of a language that take part, however many languages there are
ROUNDS = 2
SMOOTHING = 0.1
MEMO_WORDS = 400_000
UNDECIDED = "und"
_UNKNOWN = -14.0  # log-probability of a character outside the vocabulary, in every language alike


def letters_of(text: str) -> list[str]:
    """Words of a text: maximal runs of letters, lower-cased."""
    return "".join([c if c.isalpha() else " " for c in text.lower()]).split() if not text.isascii() else text.lower().translate(_ASCII).split()


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


class Vocabulary:
    """Pieces of a public tokenizer file as a hash table over code points, for lookups of many substrings at once.

    A piece that starts a word has the mark the file gives it; words are scored with that mark in front.
    """

    MARK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        found = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.pieces = [p for p in dict.fromkeys(x.lower() for x in found) if len(p) <= LONGEST and all(c.isalpha() or c == self.MARK for c in p)]
        codes = np.zeros((len(self.pieces), LONGEST), np.uint64)
        for i, p in enumerate(self.pieces):
            codes[i, : len(p)] = [ord(c) for c in p]
        lengths = np.array([len(p) for p in self.pieces])
        keys = np.zeros(len(self.pieces), np.uint64)
        for at in range(LONGEST):
            keys = np.where(lengths > at, self.extend(keys, codes[:, at]), keys)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order

    @staticmethod
    def extend(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Key of a string made one character longer."""
        return mix64(keys * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece of each key, -1 if there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lattice(words: list[str], vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of words of one length: (their indexes, characters, pieces[word, end, piece length - 1] or -1)."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        step = max(1, 200_000 // (length + 1))
        for at in range(0, len(members), step):
            own = members[at : at + step]
            text = "".join([vocab.MARK + words[i] for i in own])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length + 1).astype(np.uint64)
            pieces = np.full((len(own), length + 1, LONGEST), -1, np.int32)
            for start in range(length + 1):
                keys = np.zeros(len(own), np.uint64)
                for size in range(1, min(LONGEST, length + 1 - start) + 1):
                    keys = vocab.extend(keys, codes[:, start + size - 1])
                    pieces[:, start + size - 1, size - 1] = vocab.find(keys)
            yield np.array(own), codes, pieces


def forward(pieces: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log of the sum over segmentations, per word, position and language; row 0 is the empty prefix."""
    n, length, _ = pieces.shape
    total = np.full((n, length + 1, logs.shape[1]), -np.inf)
    total[:, 0] = 0
    for end in range(1, length + 1):
        parts = [total[:, end - 1] + np.where(pieces[:, end - 1, :1] >= 0, logs[pieces[:, end - 1, 0]], _UNKNOWN)]
        for size in range(2, min(LONGEST, end) + 1):
            number = pieces[:, end - 1, size - 1]
            hit = np.flatnonzero(number >= 0)
            if len(hit):
                part = np.full((n, logs.shape[1]), -np.inf)
                part[hit] = total[hit, end - size] + logs[number[hit]]
                parts.append(part)
        total[:, end] = parts[0] if len(parts) == 1 else np.logaddexp.reduce(parts)
    return total


def expected(words: list[str], counts: np.ndarray, vocab: Vocabulary, logs: np.ndarray | None, languages: np.ndarray) -> np.ndarray:
    """Expected piece counts[piece, language] of words with counts, by the forward and backward algorithms.

    Without a model (first round) every piece in a word counts, weighted by its length.
    """
    out = np.zeros((len(vocab.pieces), int(languages.max()) + 1 if len(languages) else 1)) if logs is None else np.zeros(logs.shape)
    for own, _, pieces in lattice(words, vocab):
        n, length, _ = pieces.shape
        language, weight = languages[own], counts[own]
        if logs is None:
            for size in range(1, LONGEST + 1):
                row, end = np.nonzero(pieces[:, :, size - 1] >= 0)
                np.add.at(out, (pieces[row, end, size - 1], language[row]), weight[row] * size)
            continue
        ahead = forward(pieces, logs)[np.arange(n), :, language]
        back = np.full((n, length + 1), -np.inf)
        back[:, length] = 0
        for start in range(length - 1, -1, -1):
            one = pieces[:, start, 0]
            value = back[:, start + 1] + np.where(one >= 0, logs[one, language], _UNKNOWN)
            for size in range(2, min(LONGEST, length - start) + 1):
                number = pieces[:, start + size - 1, size - 1]
                value = np.logaddexp(value, np.where(number >= 0, back[:, start + size] + logs[number, language], -np.inf))
            back[:, start] = value
        for size in range(1, LONGEST + 1):
            row, end = np.nonzero(pieces[:, :, size - 1] >= 0)
            number = pieces[row, end, size - 1]
            share = np.exp(ahead[row, end + 1 - size] + logs[number, language[row]] + back[row, end + 1] - back[row, 0])
            np.add.at(out, (number, language[row]), weight[row] * share)
    return out


def _sampled(rows: DataFrame, held: dict[str, int], most: int) -> DataFrame:
    """``text`` and ``lang`` of the ``most`` distinct texts of each language that are first by their hash.

    ``held`` has about the number of distinct texts of each language: the hashes are cut at a bound that leaves half as many
    again before copies are dropped and the texts ordered, so that no more than that is ordered.
    """
    bounds = [(name, int(min(1.0, 1.5 * most / max(1, n)) * (1 << 40))) for name, n in held.items()]
    bounds = rows.sparkSession.createDataFrame(bounds, "lang string, bound long")
    first = F.pmod("hash", F.lit(1 << 40))
    near = rows.join(F.broadcast(bounds), "lang").filter(first < F.col("bound")).dropDuplicates(["lang", "hash"])
    order = Window.partitionBy("lang").orderBy(first, "hash")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("text", "lang")


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, path: str | None = None) -> dict:
    """Languages and log-probabilities [piece, language] from ``text`` and non-null ``lang`` of the rows ``training`` selects.

    All languages of the training rows are learned. Of each, the same number of distinct texts takes part, ``sample`` in all but
    at least LEAST of a language, or all it has, chosen by a hash of the text; copies count once. Their words are counted and
    their expectations formed in the tasks; only a count per language and piece counts (vocabulary times languages) reach the
    driver.
    """
    path = path or tokenizer_file(PIECES)
    rows = docs.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(9)))
    held = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash")).collect()}
    languages = sorted(held)
    if languages:
        rows = land(_sampled(rows, held, max(LEAST, -(-sample // len(languages)))), "sample")
    logs = None
    size = len(vocabulary(path).pieces)
    for _ in range(ROUNDS if languages else 0):
        shared = docs.sparkSession.sparkContext.broadcast(logs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Counter] = {i: Counter() for i in range(len(languages))}
            number = {name: i for i, name in enumerate(languages)}
            vocab = vocabulary(path)
            out = np.zeros((len(vocab.pieces), len(languages)))

            def flush() -> None:
                for i, words in held.items():
                    if words:
                        found = expected(list(words), np.array(list(words.values()), float), vocab, shared.value, np.full(len(words), i))
                        out[:, : found.shape[1]] += found
                        words.clear()

            for batch in batches:
                for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[number[name]].update(letters_of(t))
                if sum(map(len, held.values())) > MEMO_WORDS:
                    flush()
            flush()
            piece, language = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(out[piece, language])], ["piece", "language", "n"])

        counts = np.zeros((size, len(languages)))
        found = rows.mapInArrow(count, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts[found["piece"].to_numpy(int), found["language"].to_numpy(int)] = found["n"].to_numpy()
        logs = np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0))
    return {"languages": languages, "logs": logs, "path": path}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``: the likeliest language and its share of the summed likelihood; one scan.

    Only ``text`` is read for it. A null text, one without a letter, and any text under a model without languages are
    ``und`` with score 0. Ties go to the language first in order. Input columns of those names are replaced.
    """
    rest = docs.drop("lang_pred", "score")
    schema = rest.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages, logs, vocab = model["languages"], model["logs"], vocabulary(model["path"])
        memo: dict[str, int] = {}
        table = np.zeros((0, len(languages)))
        for batch in batches:
            names, scores = [], []
            texts = batch.column(text).to_pylist()
            for at in range(0, len(texts), 128):
                words = [letters_of(t) if t and languages else [] for t in texts[at : at + 128]]
                new = [w for w in set().union(*words) if w not in memo]
                if len(memo) + len(new) > MEMO_WORDS:
                    memo, table = {}, table[:0]
                    new = list(set().union(*words))
                if new:
                    found = np.empty((len(new), len(languages)))
                    for own, _, pieces in lattice(new, vocab):
                        found[own] = forward(pieces, logs)[:, -1]
                    memo.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    table = np.concatenate([table, found])
                for own in words:
                    if not own:
                        names.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    sums = table[np.fromiter(map(memo.__getitem__, own), np.int64, len(own))].sum(axis=0)
                    best = int(sums.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(sums - sums[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, schema)
