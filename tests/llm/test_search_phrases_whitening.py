"""Exact search, phrase collocations and whitening against brute force, with nulls, empty tables, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketflow.llm import collocations, elimination, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string"


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def random_vectors(count, width=6, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, spread, width).astype(np.float32).tolist(), 0) for i in range(count)]


AWKWARD = [(900, None, 1), (950, [], 1), (1000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1050, [float("nan")] + [0.0] * 5, 1), (1100, [float("inf")] + [0.0] * 5, None)]


# Exact search


def search_by_hand(rows, k):
    rows = [(i, whole(v, 256)) for i, v, _ in rows if i is not None and usable(v)]
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        pairs = [(-sum(a * b for a, b in zip(v, w, strict=False)), j) for i, v in rows if i == q for j, w in rows if j != q]
        for rank, (s, j) in enumerate(sorted(pairs)[:k], 1):
            out.append((q, rank, j, -s))
    return out


def searched(spark, rows, schema=VECTORS, **options):
    found = elimination.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, **options)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, found.collect()))


def test_search_equals_brute_force_with_ties_repeats_and_unusable_rows(spark):
    rows = random_vectors(260) + AWKWARD + [(None, [1.0] * 6, 1), (1150, [0.0] * 6, 1), (1200, [9.0] * 6, 1)]
    rows += [(300 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], 2) for i in range(90)]  # copies of one vector, two of them queries
    assert searched(spark, rows, block_rows=40) == search_by_hand(rows, 5)
    assert searched(spark, rows, block_rows=40, k=1, pivots=2) == search_by_hand(rows, 1)


def test_search_repeated_keys_lengths_and_few_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (0, [3.0], 0), (50, [1.0], 0), (50, [1.0], 0), (7, [-1.0, 4.0, 9.0], 0)]
    assert searched(spark, rows) == search_by_hand(rows, 5)
    assert searched(spark, rows[:1]) == []
    assert searched(spark, []) == []
    assert searched(spark, AWKWARD) == []


def test_search_beyond_machine_words_keeps_its_order(spark):
    rows = [(0, [2.0**50, 1.0], 0), (1, [2.0**50, 0.0], 0), (2, [2.0**50, 1.0], 0), (3, [-(2.0**50), 1.0], 0), (4, [2.0**-8, 0.0], 0)]
    want = [(q, r, j, s if -(2**63) <= s < 2**63 else None) for q, r, j, s in search_by_hand(rows, 5)]
    got = searched(spark, rows)
    assert got == want and any(s is None for *_, s in got) and any(s is not None for *_, s in got)


def test_search_ignores_clashing_columns(spark):
    rows = random_vectors(60)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("block", "far", "row", "v", "query_id", "score", "rank", "asks")})
    assert sorted(map(tuple, elimination.search(frame, F.col("vec_id") % 50 == 0).collect())) == search_by_hand(rows, 5)


def test_elimination_spares_rows_and_blocks():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 600, (20, 16))
    x = np.floor(centres[np.arange(4000) % 20] + rng.normal(0, 4, (4000, 16)))
    pivots = np.vstack([np.zeros(16), centres])
    far, ids = elimination.distances(x, pivots), np.arange(4000)
    block = elimination.Block(x, far, ids)
    for q in (0, 7, 1999):
        got, evaluated = block.answer(x[q], far[q], q, 5)
        scores = (x @ x[q]).astype(np.int64)
        want = sorted(((int(s), i) for i, s in enumerate(scores) if i != q), key=lambda p: (-p[0], p[1]))[:5]
        assert got == want and evaluated < 2000  # bounds, not the whole table
        assert block.answer(x[q], far[q], q, 5, least=want[-1][0])[0] == want


def test_integer_products_are_exact_at_every_size():
    for size in (3.0, 2.0**25, 2.0**30, 2.0**60):
        a = np.array([[size, -size, 1.0], [1.0, 2.0, 3.0]])
        want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in a.tolist()] for x in a.tolist()]
        assert vectors.products(a, a).tolist() == want


# Phrase collocations


def phrases_by_hand(docs, least, kept):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {}
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                found[p] = (a, *min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))))
        gone = {q[i : i + m] for q, v in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * v[0] >= 80 * f[q[i : i + m]]}
        best = sorted(((-v[1], -v[0], " ".join(p).encode(), v) for p, v in found.items() if p not in gone))[:kept]
        out += [(lang, r, p.decode(), v[0], v[3], v[4], totals[lang], v[1]) for r, (_, _, p, v) in enumerate(best, 1)]
    return sorted(out)


def babble(count, seed, vocabulary=30, length=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Été", "ß", "日本", "ÉT"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x1c", "\r\n", "! "]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(length))) for _ in range(count)]


def corpus():
    texts = babble(150, 1) + [None, "", " \t", ".,;", "New York City Hall. " * 40, "new york city hall " * 3, "a a a a a a " * 20, "x" * 30000]
    return [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts)] + [(1, "same same row " * 5, "en")] * 9


@pytest.fixture
def small_limits(monkeypatch):
    for name, value in (("BURST", 8), ("HELD_ENTRIES", 300), ("HELD_WORDS", 25), ("BLOCK_BYTES", 600), ("SHARE", 4)):
        monkeypatch.setattr(collocations, name, value)


def test_collocations_equal_brute_force(spark):
    docs = spark.createDataFrame(corpus(), DOCS).withColumns({c: F.lit(1) for c in ("rank", "phrase", "n", "f", "words", "score")})
    for least, kept in ((4, 50), (30, 2000)):
        assert sorted(map(tuple, collocations.collocations(docs, least=least, kept=kept).collect())) == phrases_by_hand(corpus(), least, kept)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.filter("text is null")).count() == 0


def test_bursting_and_spilling_lose_nothing(small_limits):
    batch = pa.record_batch([pa.array([t for _, t, _ in corpus()]), pa.array([lang for *_, lang in corpus()])], ["text", "lang"])
    counter, runs, nodes = collocations.Counter(1, 4, None), [], 0
    for block in collocations.blocks(batch, "text", 600):
        found = list(counter.read(block))
        nodes = max(nodes, len(counter.trie.root.children))
        runs += found
    assert runs and nodes  # subtrees left before the end, containers burst
    runs += counter.spill()
    assert counter.trie.entries == 0
    got, want = Counter(), Counter()
    for r in runs:
        keys = [tuple(key.split("\n")) for key in r.column(0).to_pylist()]
        assert keys == sorted(keys, key=lambda k: (k[0].encode(), [w.encode() for w in k[1].split(" ")]))
        got.update(dict(zip(keys, r.column(1).to_pylist(), strict=True)) if len(set(keys)) == len(keys) else {})
    for _, text, lang in corpus():
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            want.update((lang or "und", " ".join(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert got == want


@pytest.mark.parametrize("top", [1, 30, 5_000, 8_000, 200_000, 2_000_000])
def test_unique_paths_at_every_size_of_ids(top):
    rng = np.random.default_rng(top)
    for count in (2, 3, 5):
        heads = rng.integers(0, top, (40, count))
        heads[:, -1][::3] = -1
        paths = heads[rng.integers(0, 40, 500)]
        got, counts = collocations._unique(list(paths.T))
        want, sizes = np.unique(paths, axis=0, return_counts=True)
        assert got.tolist() == want.tolist() and counts.tolist() == sizes.tolist()


def test_pair_filter_misses_no_pair(spark):
    pairs = [("en", f"a{i} b{i % 7}") for i in range(500)]
    words = collocations.pair_filter(spark.createDataFrame(pairs, "lang string, phrase string"), len(pairs))
    hashed = [np.array([collocations._hash(h) for h in part], np.uint64) for part in zip(*[(lang, *p.split(" ")) for lang, p in pairs], strict=True)]
    assert collocations.in_filter(words, collocations.pair_hash(*hashed)).all()
    assert collocations.in_filter(words, collocations.pair_hash(hashed[0], hashed[2], hashed[1])).mean() < 0.2


# Whitening


def covariance_by_hand(x):
    n, width = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(width)]
    return mean, np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(width)] for i in range(width)])


def test_inertia_counts_and_leading_pairs():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 17, 40):
        a = rng.normal(size=(size, size))
        a = a + a.T
        for shift in (-2.0, 0.0, 0.3):
            want = np.linalg.eigvalsh(a)
            assert whitening.inertia(a, shift) == ((want > shift).sum(), 0, (want < shift).sum())
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for spectrum in (rng.uniform(1, 9, size), np.full(size, 4.0), np.repeat([5.0, 5.0, 2.0], size)[:size], 2.0 ** -np.arange(size)):
            m = (q * spectrum) @ q.T
            values, rows = whitening.leading((m + m.T) / 2, 8)
            assert np.allclose(values, np.sort(spectrum)[::-1][:8], rtol=0, atol=1e-12 * spectrum.max())
            assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-9 and np.abs(m @ rows.T - rows.T * values).max() < 1e-10
    assert whitening.inertia(np.diag([1.0, 2.0, 2.0, 3.0]), 2.0) == (1, 2, 1)
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == (1, 0, 1)


def test_whitening_equals_exact_covariance(spark):
    rows = random_vectors(120) + AWKWARD + [(7, [0.25] * 6, 3), (7, [0.25] * 6, 3), (None, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 3), (5000, [1.0], 3)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("component", "whitened", "deviation", "n", "v", "at")})
    got = whitening.whiten(frame).collect()
    used = [(i, [w + 100000 for w in whole(v, 1024)]) for i, v, _ in rows if usable(v) and len(v) == 6]
    x = [v for _, v in used]
    mean, cov = covariance_by_hand(x)
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    assert len(got) == 6 * len(used) and {r.n for r in got} == {len(used)} and got[0].identity_error < 1e-9
    want = (np.array([[float(e - m) for e, m in zip(v, mean, strict=True)] for v in x]) @ vectors_) / np.sqrt(values)
    deviation = [sum((len(x) * e - int(m * len(x))) ** 2 for e, m in zip(v, mean, strict=True)) for v in x]
    for c in range(6):
        mine = sorted(((r.vec_id is None, r.vec_id, round(abs(r.whitened), 8), r.deviation) for r in got if r.component == c + 1), key=str)
        hand = sorted(((i is None, i, round(abs(w[c]), 8), d) for (i, _), w, d in zip(used, want, deviation, strict=True)), key=str)
        assert [m[3] for m in mine] == [h[3] for h in hand] and np.allclose([m[2] for m in mine], [h[2] for h in hand], atol=1e-7)
        assert abs(next(r.explained for r in got if r.component == c + 1) - values[c] / values.sum()) < 1e-12
    signs = {c: {np.sign(r.whitened * w[c - 1]) for r in got if r.component == c for (i, _), w in zip(used, want, strict=True) if i == r.vec_id and i not in (7, None) and abs(w[c - 1]) > 1e-6} for c in range(1, 7)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_huge_entries_stays_exact(spark):
    rows = [(i, [2.0**44 * (1 + i % 3), float(i), 1.0], 0) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    x = [[w + 100000 for w in whole(v, 1024)] for _, v, _ in rows]
    sums = [sum(r[i] for r in x) for i in range(3)]
    want = {i: sum((30 * e - s) ** 2 for e, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want
    assert all(r.deviation is None or r.deviation == want[r.vec_id] for r in got)


def test_whitening_without_rows_or_variance(spark):
    for rows in ([], AWKWARD, [(1, [0.5, 0.25], 0)] * 4):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    flat = [(i, [float(i % 2), 1.0, 2.0 * (i % 2)], 0) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert {r.component for r in got} == {1} and {round(abs(r.whitened), 9) for r in got} == {1.0}


def test_a_block_of_short_words_stays_small():
    """Very frequent short words: a block's arrays stay far below a worker's share of memory."""
    import tracemalloc

    from marketflow.llm import collocations

    text = "a bc " * (collocations.BLOCK_BYTES // 5)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text]), "lang": pa.array(["en"])})
    tracemalloc.start()
    try:
        list(collocations.Counter(1, 2, None).read(batch))
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
