"""Byte-pair encoding and decoding by speculation: greedy longest match proposes, pair checks verify, only failures are merged.

A sequence of tokens is the encoding of its string exactly when every token encodes to itself and every adjacent pair is
compatible, that is, when no merge across the border would have been taken before the merges that built its two sides. The
check walks both sides' merge trees towards the border; it runs in numpy over all adjacent pairs of a batch at once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import tokenizer_file

WORD_BPE = "word_bpe_49k.json"
END_OF_WORD = "</w>"
BLOCK_BYTES = 8 << 20  # text encoded at once; its distinct words are encoded once
CHUNKED_TEXTS = 128  # texts whose words are Python strings at a time
_LAST = 0x8000  # offset that marks the last symbol of a word, which carries the end-of-word suffix
_NEVER = np.int64(1 << 40)
# White space of the tokenizer's normaliser: the Unicode property, without the four separators str.split() also takes.
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD_SPLIT = re.compile("[\x1c-\x1f]")
# Chunks of these characters need no normalisation but lower case: all are composed, and none spans a pre-token with others.
_LATIN = re.compile("[!-~\xa1-\u024f]+")
_LETTERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
_LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# Byte-level symbols: printable bytes stand for themselves, the others take code points from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


# Anything but Latin letters (all composed, and lower-cased alone), white space, full stops and commas.
_UNEASY = re.compile("[^A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f \\t-\\r\x85\xa0.,]")


def _easy(text: str) -> bool:
    """Whether lower case and a space before each full stop and comma leave one pre-token between white space."""
    return not (_UNEASY.search(text) or ".." in text or ".," in text or ",." in text or ",," in text)


def _words(text: str) -> list[str]:
    return text.lower().replace(",", " , ").replace(".", " . ").split()


def chunks_of(text: str) -> list[str]:
    """A text cut where pre-tokens surely end; the tokenizer works on each part alone.

    Plain lines are cut into their lower-cased pre-tokens, which recur most; the others at white space.
    """
    if _easy(text):
        return _words(text)
    if _ODD_SPLIT.search(text):
        return [c for c in _SPACE.split(text) if c]
    return [c for line in text.split("\n") for c in (_words(line) if _easy(line) else line.split())]


class WordPieces:
    """Pre-tokens of a chunk as byte-level strings, by the tokenizer's own normaliser and pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.hint = "<|" if all("<|" in s for s in self.special) else ""

    def parts(self, chunk: str) -> list[str | int]:
        """Byte-level pre-tokens, and ids of special tokens written out in the chunk."""
        if self.cut is not None and self.hint in chunk and self.cut.search(chunk):
            out: list[str | int] = []
            for part in self.cut.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self.plain(part)
            return out
        return self.plain(chunk)

    def plain(self, chunk: str) -> list[str]:
        low = chunk.lower()
        if _LATIN.fullmatch(low) and "\u0130" not in chunk:
            found = [low] if low.isalpha() else _LATIN_PIECES.findall(low)
            return found if low.isascii() else [p.encode().decode("latin-1").translate(_BYTE_LEVEL) for p in found]
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))]


class Bpe:
    """Tables of one tokenizer file and the vectorised encoder over distinct words."""

    def __init__(self, path: str):
        self.words = WordPieces(path)
        model = json.loads(self.words.tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END_OF_WORD:
            raise ValueError("a BPE file with end-of-word symbols is needed")
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.words.special.values()]) + 1
        self.text = [""] * size
        for token, i in vocab.items():
            self.text[i] = token
        for token, i in self.words.special.items():
            self.text[i] = token
        self.ids = {self.symbols(token): i for token, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        triples = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.whole = triples[:, 2]
        self.rank[self.whole], self.left[self.whole], self.right[self.whole] = np.arange(len(triples)), triples[:, 0], triples[:, 1]
        keys = triples[:, 0] << 32 | triples[:, 1]
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        made = np.flatnonzero(self.rank >= 0)
        self.sound = np.ones(size, bool)
        # In merge order: a token encodes to itself if both halves do and nothing across its border would merge first.
        ok = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            self.sound[i] = self.sound[self.left[i]] and self.sound[self.right[i]]
        self.sound[made] &= ok

    @staticmethod
    def symbols(token: str) -> str:
        if token.endswith(END_OF_WORD) and len(token) > len(END_OF_WORD):
            body = token[: -len(END_OF_WORD)]
            return body[:-1] + chr(ord(body[-1]) + _LAST)
        return token

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For every pair: no merge across the border comes before the merges that made its sides (or ``limit``)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        # A merge across the border happens if its rank is below the rank of the next merge that would change either side.
        bound = np.full(len(a), _NEVER) if limit is None else limit.astype(np.int64)
        left_wins = np.full(len(a), limit is not None)  # on equal ranks the leftmost place merges first
        while len(live):
            key = a[live] << 32 | b[live]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            bad = (rank < bound[live]) | ((rank == bound[live]) & ~left_wins[live] & (rank < _NEVER))
            good[live[bad]] = False
            live = live[~bad]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            live, ra, rb = (x[(ra >= 0) | (rb >= 0)] for x in (live, ra, rb))
            # Undo the later of the two last merges; at equal ranks the right one, done last.
            undo_left = ra > rb
            l, r = live[undo_left], live[~undo_left]
            bound[l], left_wins[l] = self.rank[a[l]], True
            a[l] = self.right[a[l]]
            bound[r], left_wins[r] = self.rank[b[r]], False
            b[r] = self.left[b[r]]
        return good

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging each pair; never for pairs without a merge or with padding (-1)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NEVER)

    def merged(self, words: list[str]) -> list[list[int]]:
        """Exact merging of words in symbols, all words a step at a time: the lowest rank first, the leftmost on ties."""
        out: list[list[int]] = [[]] * len(words)
        by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(by_length):
            # Blocks of similar length: at most about 500,000 cells each, so a very long word stands alone.
            end, longest = start + 1, len(words[by_length[start]])
            while end < len(by_length) and (end + 1 - start) * len(words[by_length[end]]) <= 500_000:
                longest = len(words[by_length[end]])
                end += 1
            rows = np.array(by_length[start:end])
            start = end
            ids = np.full((len(rows), longest + 1), -1, np.int64)
            for k, i in enumerate(rows):
                ids[k, : len(words[i])] = [self.ids[c] for c in words[i]]
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            columns = np.arange(longest + 1)
            while len(rows):
                at = rank.argmin(axis=1)
                lowest = rank[np.arange(len(rows)), at]
                done = lowest == _NEVER
                if done.any():
                    for k in np.flatnonzero(done):
                        out[rows[k]] = ids[k][ids[k] >= 0].tolist()
                    rows, ids, rank, at, lowest = rows[~done], ids[~done], rank[~done], at[~done], lowest[~done]
                    if not len(rows):
                        break
                every = np.arange(len(rows))
                take = np.minimum(columns + (columns > at[:, None]), longest)
                moved = np.take_along_axis(ids, take, 1)
                moved[:, -1] = -1
                moved[every, at] = self.whole[lowest]
                ids = moved
                rank = np.take_along_axis(rank, np.minimum(take[:, :-1], longest - 1), 1)
                rank[:, -1] = _NEVER
                after = np.minimum(at, longest - 1)
                rank[every, after] = self.ranks(ids[every, after], ids[every, after + 1])
                before = np.maximum(at - 1, 0)
                rank[every, before] = self.ranks(ids[every, before], ids[every, before + 1])
        return out

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left over the symbols of one word."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            end = min(n, at + longest)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of byte-level words."""
        words = [w[:-1] + chr(ord(w[-1]) + _LAST) for w in words]
        proposed = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[owner[inner[~fine[back]]]] = True
        failing = np.flatnonzero(bad)
        for i, ids in zip(failing, self.merged([words[i] for i in failing]), strict=True):
            proposed[i] = ids
        return proposed


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def gather(offsets: np.ndarray, data: pa.Buffer, index: np.ndarray | pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
    """Rows ``index`` of a binary column (64-bit offsets and bytes), runs of ``sizes`` rows joined into one each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not ends[-1]:
        return np.zeros(len(ends), np.int64), pa.py_buffer(b"")
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])
    _, starts, found = column.take(pa.array(index) if isinstance(index, np.ndarray) else index).buffers()
    return np.frombuffer(starts, np.int64)[ends], found or pa.py_buffer(b"")


class Blocks:
    """Encodes texts block by block: a block's distinct chunks are cut into pre-tokens, and its distinct pre-tokens encoded, once.

    Nothing is kept from block to block, so that memory is bounded by the block. Words are found again in Arrow, not in Python.
    """

    def __init__(self, split: WordPieces):
        self.split = split

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte-level pre-tokens in order, and how many each has."""
        raise NotImplementedError

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a block of texts: text ``i`` has ``ids[offsets[i] : offsets[i + 1]]``, none if null or empty."""
        # Many small strings are made here, none of them part of a cycle.
        collecting = gc.isenabled()
        gc.disable()
        try:
            sizes, parts = [], []
            for at in range(0, len(texts), CHUNKED_TEXTS):
                rows = [chunks_of(t or "") for t in texts.slice(at, CHUNKED_TEXTS).to_pylist()]
                sizes += map(len, rows)
                parts.append(pa.array(list(chain.from_iterable(rows)), pa.large_string()))
                del rows
            every = (pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())).dictionary_encode()
            del parts
            offsets, data = gather(*self._distinct(every.dictionary.to_pylist()), every.indices, np.array(sizes, np.int64))
        finally:
            if collecting:
                gc.enable()
        return offsets // 4, np.frombuffer(data, "<u4")[: offsets[-1] // 4]

    def _distinct(self, chunks: list[str]) -> tuple[np.ndarray, pa.Buffer]:
        """Ids of distinct chunks as a binary column."""
        parts = [[low] if (low := c.lower()).isalpha() and low.isascii() else self.split.parts(c) for c in chunks]
        found = dict.fromkeys(chain.from_iterable(parts))
        special = [p for p in found if isinstance(p, int)]
        words = [p for p in found if not isinstance(p, int)] if special else list(found)
        number = dict(zip([*words, *special], range(len(found)), strict=True))
        ids, lengths = self.words(words)
        ids = np.concatenate([ids, special]).astype("<u4")
        ends = 4 * np.concatenate([[0], np.cumsum(lengths), ids.size - len(special) + 1 + np.arange(len(special))]).astype(np.int64)
        index = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64)
        return gather(ends, pa.py_buffer(ids), index, np.fromiter(map(len, parts), np.int64, len(parts)))


class Encoder(Blocks):
    """The speculative encoder, and the decoder: tokens joined by a space, as a tokenizer without a decoder does."""

    def __init__(self, path: str):
        self.bpe = load(path)
        super().__init__(self.bpe.words)
        spelled = [f"{t} ".encode() for t in self.bpe.text]
        self.token_ends, self.tokens = np.cumsum([0, *map(len, spelled)]), pa.py_buffer(b"".join(spelled))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.bpe.encode_words(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), lengths

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[memoryview]:
        """Decoded texts of a block in UTF-8."""
        ends, data = gather(self.token_ends, self.tokens, ids, np.diff(offsets))
        whole = memoryview(data)
        return [whole[a : max(a, b - 1)] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text of one block; a null text is empty."""
        ends, ids = self.encode_block(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        return [(ids[a:b].tobytes(), str(t, "utf-8")) for a, b, t in zip(ends, ends[1:], self.decode(ends, ids), strict=False)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with at most ``most`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def decode(ids: bytes, path: str) -> str:
    """Text of little-endian ids: tokens joined by a space, as a tokenizer without a decoder does."""
    text = load(path).text
    return " ".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (string) to ``docs``; one scan, no shuffle.

    Null and empty texts give no ids and an empty decoded text. Input columns of those two names are replaced. Texts of any
    length are encoded whole. Special tokens written out in a text take their id, as the tokenizer does by default.
    """
    path = path or tokenizer_file(WORD_BPE)
    rest = docs.drop("ids", "decoded")
    schema = rest.withColumns({"ids": F.lit(b""), "decoded": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in chain.from_iterable(blocks(b, text) for b in batches):
            found = encoder.encode(batch.column(text))
            ids, decoded = [a for a, _ in found], [b for _, b in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*batch.schema.names, "ids", "decoded"])

    return rest.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: token count and digests of ids and decoded text, taken in the encoding task so that neither travels."""
    path = path or tokenizer_file(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in chain.from_iterable(blocks(b, "text") for b in batches):
            ends, ids = encoder.encode_block(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(ends)),
                    pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in encoder.decode(ends, ids)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
