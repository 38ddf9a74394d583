"""The corpus operators against brute force, libraries and SQL, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.llm import bpe, common, forest, language, minhash, mixing, pivots, quality, queries, secret_scan, token_files, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
TEXTS = ["Hello, world's été", None, "", " \n\t", "x" * 5000, "a <|endoftext|>b", "it's THE 42nd\x1ctest", "日本語 テスト Σσς", "same text", "same text"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_file(bpe.WORD_BPE))


def random_texts(count, seed=1):
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwyz'.,!?-_0123456789éßÉİΣσς日本 \t\n\x1c\x85\u0301"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(count)]


# Tokens


def test_bpe_equals_library(library):
    texts = TEXTS + random_texts(3000) + ["".join(random.Random(i).choice("etaoinshrdlu") for _ in range(30)) for i in range(2000)]
    for text, (ids, decoded) in zip(texts, bpe.Encoder(common.tokenizer_file(bpe.WORD_BPE)).encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert bpe.decode(ids, common.tokenizer_file(bpe.WORD_BPE)) == decoded


def test_blocks_keep_every_text_whole(library):
    import pyarrow as pa

    texts = [*TEXTS, None, "", *random_texts(200, 5), "word " * 300]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for kind in (bpe.Encoder, token_files.LibraryEncoder):
        encoder = kind(common.tokenizer_file(bpe.WORD_BPE))
        for most in (1, 100, 1 << 20):
            got = []
            for block in bpe.blocks(batch, "text", most):
                ends, ids = encoder.encode_block(block.column("text"))
                got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
            assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not list(bpe.blocks(batch.slice(0, 0), "text"))


def test_speculation_is_checked_and_mostly_right_or_merged():
    model = bpe.load(common.tokenizer_file(bpe.WORD_BPE))
    words = ["the", "anotherword", "thonening", "xqzjk"]
    symbols = [w[:-1] + chr(ord(w[-1]) + 0x8000) for w in words]
    assert model.encode_words(words) == model.merged(symbols)
    assert model.sound.all()


def test_encode_decode_replaces_clashing_columns(spark):
    docs = documents(spark, TEXTS).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    rows = bpe.encode_decode(docs).collect()
    assert len(rows) == len(TEXTS) and all(isinstance(r.ids, (bytes, bytearray)) for r in rows)
    assert bpe.encode_decode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_token_files(spark, library, shards):
    texts = TEXTS + random_texts(50, 2)
    folder = common.scratch(spark, "test-tokens")
    token_files.write(documents(spark, texts).withColumn("shard", F.lit("clash")), folder, shards)
    files = token_files.read(spark, folder)
    start, got = 0, token_files.checksums(files).orderBy("doc_id").collect()
    for i, row in enumerate(got):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)
    plan = token_files.metadata(files)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan  # metadata is read without a token page


def test_token_file_encodings(spark):
    import glob

    import pyarrow.parquet as pq

    folder = common.scratch(spark, "test-tokens")
    token_files.write(documents(spark, random_texts(300, 3)), folder, 1)
    path = next(p for p in glob.glob(folder.removeprefix("file:") + "/*.parquet"))
    columns = {c.path_in_schema: c for c in (pq.ParquetFile(path).metadata.row_group(0).column(i) for i in range(5))}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["tokens.list.element"].has_offset_index and columns["doc_id"].has_column_index


def test_token_files_of_an_empty_table(spark):
    folder = common.scratch(spark, "test-tokens")
    token_files.write(documents(spark, []), folder, 2)
    assert token_files.checksums(token_files.read(spark, folder)).count() == 0


# Secrets


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


def secret_texts():
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [None, "", "plain words only", f"é日 Token = \"{hexed}\" end", "api_key: short, password=longenough1 secret='x'", "AKIAAKIA" + "Z9" * 8, "AKIASHORT1",
             f"{hexed} and {hexed}", f"key {key} here", "internationalisationandlocalisation keitlichenlichkeitbe", "token=token=abcdefgh", "ſecret=abcdefghij"]
    return texts, key


def test_base_secrets_equal_brute_force(spark):
    texts, _ = secret_texts()
    rows = {r.doc_id: r for r in secret_scan.report(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]


def test_battery_adds_random_tokens_and_leaves_words_alone(spark):
    texts, key = secret_texts()
    spans = {r.doc_id: r.spans for r in secret_scan.report(documents(spark, texts)).collect()}
    assert spans[8] == f"random:4:{4 + len(key)}"
    assert spans[9] == "" and spans[2] == ""


def test_redaction_keeps_rows_and_other_text(spark):
    texts, key = secret_texts()
    docs = documents(spark, texts).withColumn("secret_spans", F.lit("clash"))
    rows = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert len(rows) == len(texts) and rows[0].text is None and rows[2].text == texts[2]
    assert rows[8].text == "key [SECRET] here" and rows[8].n_chars == len(rows[8].text)
    assert secret_scan.redact(documents(spark, [])).count() == 0


# Quality, mixing, language


def test_quality_agrees_with_held_labels(spark):
    root = "/root/testdata/sf0.01"
    judged = quality.classify(common.table(spark, root, "documents").select("doc_id", "text"))
    rows = judged.join(common.table(spark, root, "labels"), "doc_id").select("quality", "keep").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.4


def test_quality_of_nulls_and_empty_tables(spark):
    rows = quality.classify(documents(spark, [None, "", "  ", "Fine words. They end well."] + ["Good prose. It ends."] * 30).withColumn("keep", F.lit("clash"))).orderBy("doc_id").collect()
    assert [r.keep for r in rows[:4]] == [False, False, False, True]
    assert quality.classify(documents(spark, [])).count() == 0


def test_estimation_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    votes = np.where(good[:, None], 0, np.where(rng.random((20_000, 6)) < 0.3, -1, 0))
    votes = np.concatenate([votes, np.where(rng.random((20_000, 2)) < np.where(good, 0.9, 0.2)[:, None], 1, 0)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03 and np.all(np.abs(table[0, :6, 0] - 0.3) < 0.05) and np.all(np.abs(table[1, 6:, 2] - 0.9) < 0.03)


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(100, 10_000, 24).astype(float)
    members = [np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.full(6, 1 / 6)]
    p, room = mixing.rake(tokens, members, targets, 0.2)
    for place, target in zip(members, targets, strict=True):
        assert np.allclose(np.bincount(place, tokens * p), target * room, rtol=1e-6)
    assert (p <= 1).all()


def test_mixing_hits_targets_and_repeats_decisions(spark):
    rows = [(i % 3000, "word " * (1 + i % 50), "en" if i % 3 else "fr", f"src{i % 4}" if i % 7 else None, 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.weigh(docs, 0.3, {"src0": 0.4, "other": 0.6}, {"en": 0.5, "other": 0.5}, {"other": 1.0}).toPandas()
    kept = out[out.sampled]
    assert abs(kept[kept.source_group == "src0"].n_words.sum() / kept.n_words.sum() - 0.4) < 0.06
    assert abs(kept[kept.lang_group == "en"].n_words.sum() / kept.n_words.sum() - 0.5) < 0.06
    assert mixing.mix(documents(spark, [])).count() == 0


def test_scarce_values_do_not_shrink_the_mix(spark):
    rng = random.Random(5)
    marks = rng.choices(["", "licensed ", "a@b.c "], [0.85, 0.1, 0.05], k=4000)
    langs = rng.choices(["en", "de", "fr", "es"], [0.5, 0.2, 0.2, 0.1], k=4000)
    rows = [(i, mark + "word " * (20 + i % 11), lang, f"src{rng.randrange(5)}", 0) for i, (mark, lang) in enumerate(zip(marks, langs, strict=True))]
    rows += [(9001, "https://a.b " + "word " * 99, "en", "src3", 0), (9002, "word " * 50, None, "src4", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.weigh(docs).toPandas()
    total, kept = out.n_words.sum(), out[out.sampled]
    assert abs(kept.n_words.sum() / total - mixing.BUDGET) < 0.03
    assert {9001, 9002} <= set(kept.doc_id)
    report = mixing.report(docs).set_index(["marginal", "value"])
    assert np.allclose(report.groupby("marginal")["expected"].sum(), mixing.BUDGET * total)
    for value, words in ((("topic", "web"), 100), (("lang_group", "other"), 50)):
        assert np.isclose(report.loc[value, "expected"], words) and np.isclose(report.loc[value, "shortfall"], report.loc[value, "wanted"] - words)
    # The shortfall goes to the others in proportion to their targets.
    assert np.isclose(report.loc[("lang_group", "en"), "expected"], (mixing.BUDGET * total - 50) * 0.55 / 0.99, rtol=1e-6)


def test_contradicting_marginals_fill_the_budget():
    # Place 0 of the first marginal is all of place 0 of the second, which wants little.
    p, room = mixing.rake(np.array([50.0, 50.0]), [np.array([0, 1])] * 2, [np.array([0.9, 0.1]), np.array([0.1, 0.9])], 0.5)
    assert room == 50 and np.isclose(np.array([50.0, 50.0]) @ p, 50) and (p <= 1).all()
    # A place without a share gives nothing.
    p, room = mixing.rake(np.array([60.0, 40.0]), [np.array([0, 1])], [np.array([1.0, 0.0])], 0.8)
    assert room == 60 and p.tolist() == [1, 0]


def test_segmentations_are_summed():
    vocab = language.vocabulary(common.tokenizer_file(language.PIECES))
    rng = np.random.default_rng(2)
    logs = np.log(rng.random((len(vocab.pieces), 2)) / 1000)
    number = {p: i for i, p in enumerate(vocab.pieces)}

    def brute(word, j):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for size in range(1, min(language.LONGEST, end) + 1):
                piece = word[end - size : end]
                if piece in number:
                    total[end] += total[end - size] * np.exp(logs[number[piece], j])
                elif size == 1:
                    total[end] += total[end - 1] * np.exp(language._UNKNOWN)
        return np.log(total[-1])

    words = ["nation", "the", "ß", "überall", "日本", "a"]
    for own, _, pieces in language.lattice(words, vocab):
        found = language.forward(pieces, logs)[:, -1]
        for row, i in enumerate(own):
            assert np.allclose(found[row], [brute(vocab.MARK + words[i], j) for j in range(2)])


def test_language_held_out_accuracy_and_edges(spark):
    got = queries.QUERIES["op9_language"](spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id")
    rows = got.filter("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97 and all(0 <= r.score <= 1 for r in rows)
    docs = spark.createDataFrame([(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, None, None), (4, "42 !!", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    preds = {r.doc_id: r.lang_pred for r in language.predict(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert preds == {1: "en", 2: "de", 3: "und", 4: "und"}
    empty = language.fit(docs.limit(0), F.lit(True))
    assert [r.lang_pred for r in language.predict(docs, empty).collect()] == ["und"] * 4


def test_every_language_is_learned_and_copies_count_once(spark):
    rows = [(i, f"the house and the garden number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} {'uvwxyz'[i // 100]}", "en") for i in range(600)]
    rows += [(1000 + i, "the same text again and again", "en") for i in range(400)] + [(2000, "das haus und der garten", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), sample=20)
    assert model["languages"] == ["de", "en"]
    tests = spark.createDataFrame([(1, "der garten und das haus"), (2, "and the garden")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(tests, model).collect()} == {1: "de", 2: "en"}
    hashed = docs.withColumn("hash", F.xxhash64("text", F.lit(9)))
    texts = [(r.lang, r.text) for r in language._sampled(hashed, {"de": 1, "en": 601}, 50).collect()]
    assert len(texts) == len(set(texts)) == 51 and ("de", "das haus und der garten") in texts


# Near-duplicates and search


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    part = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    part[i] = min(part[i], part[j])
    return [len(s) for s in sets], part


def near_texts():
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [None, "", " \t", "One", "one", "two words", "Two\x0bwords", "é É", "a b c", "A b\tc"]
    for k in range(60):  # a group whose members differ from one another as much as from their template
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{k}_{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 5
    for _ in range(40):
        texts.append(" ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(3, 80))))
    return texts


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, n, percent):
    texts = near_texts()
    sizes, part = brute_components(texts, n, percent)
    rows = minhash.link(documents(spark, texts), n, percent).orderBy("doc_id").collect()
    assert [r.n_shingles for r in rows] == sizes
    assert [r.component_id for r in rows] == part
    assert [r.kept for r in rows] == [i == p for i, p in enumerate(part)]


def test_hub_group_in_blocks_equals_one_block(spark, monkeypatch):
    texts = near_texts()
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    rows = minhash.link(documents(spark, texts), 3, 85).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == brute_components(texts, 3, 85)[1]


def test_minhash_edges(spark):
    assert minhash.link(documents(spark, [])).count() == 0
    docs = documents(spark, near_texts())
    kept = minhash.deduplicate(docs.union(docs).withColumn("node", F.lit("clash")))
    assert kept.columns == [*docs.columns, "node"]
    part = brute_components(near_texts(), 5, 80)[1]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(part))


def test_deduplicate_drops_copies_only(spark):
    rng = random.Random(8)
    a, b, c, d, e, f, g = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(40)) for k in "abcdefg")
    near = " ".join([*d.split(), "more"])
    rows = [(None, a), (None, b), (None, a), (None, None), (None, None), (None, " \x0b")]  # null ids: two texts, one twice
    rows += [(5, c), (5, d), (6, near), (4, near), (5, e)]  # one id with three texts, one of them a near copy of document 4
    rows += [(7, f), (7, f), (None, f), (8, f), (8, g), (9, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in minhash.deduplicate(docs).collect()]
    want = [(None, a), (None, b), (None, None), (None, None), (None, " \x0b"), (5, c), (4, near), (5, e), (7, f), (8, g), (9, ""), (9, None)]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))


def vectors(seed=3, count=300):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((count, 16))
    rows[50:120] = rows[50] + 0.06 * rng.standard_normal((70, 16))  # a group of near copies
    rows[120:125] = rows[7]
    table = [(int(i), [float(x) for x in np.float32(v)], int(i % 2) if i < 50 else 1) for i, v in enumerate(rows)]
    table += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, table[60][1], None)]
    return table


@pytest.mark.parametrize("leaf", [1000, 30])
def test_forest_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(forest, "LEAF_ROWS", leaf)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(forest, "SPILL", 0.1)
    table = vectors()
    rows = {r.vec_id: r for r in forest.link(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("leaves", F.lit(1))).collect()}
    good = [t for t in table if t[0] < 900]
    values = np.array([t[1] for t in good])
    units = values / np.sqrt((values**2).sum(axis=1))[:, None]
    labels = np.array([t[2] for t in good])
    close = (units @ units.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(good), dtype=bool)
    part = np.arange(len(good))
    for _ in range(len(good)):
        new = np.where(close, part[None, :], len(good)).min(axis=1)
        if (np.minimum(part, new) == part).all():
            break
        part = np.minimum(part, new)
    assert [rows[i].n_links for i in range(len(good))] == close.sum(axis=1).tolist()
    assert [rows[i].component_id for i in range(len(good))] == part.tolist()
    assert all(rows[i].n_links == 0 and rows[i].kept for i in range(900, 906)) and len(rows) == len(table)
    assert forest.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("blocks", [1, 2])
def test_forest_unites_chains_and_stars_in_any_order(blocks):
    # Neighbours on a chain, and a star's centre and its arms, have a cosine of at least 0.98, others less.
    step = np.arccos(0.98) * 0.99
    chain = np.array([[np.cos(i * step), np.sin(i * step), 0, 0, 0] for i in range(5)])
    star = np.array([[1, 0, 0, 0, 0]] + [np.cos(step) * np.eye(5)[0] + np.sin(step) * np.eye(5)[i] for i in range(1, 5)])
    for table, chained in ((chain, True), (star, False)):
        for ids in itertools.permutations(range(5)):
            # Chains and stars have two colours, so that with two blocks all links cross.
            side = [i % 2 if chained else int(i > 0) for i in range(5)] if blocks == 2 else [0] * 5
            frame = pd.DataFrame({"vec_id": ids, "v": list(table), "leaf": 0, "side": side, "copies": 1, "leaves": [[0]] * 5})
            found = forest.compare_block(frame, 0.98)
            assert len(found) == 5 and (found["low"] == 0).all()
            expected = [1, 2, 2, 2, 1] if chained else [4, 1, 1, 1, 1]
            assert dict(zip(found["vec_id"], found["n"], strict=True)) == dict(zip(ids, expected, strict=True))


def test_forest_components_of_chains(spark):
    step = np.arccos(0.98) * 0.99
    rng = np.random.default_rng(11)
    rows = []
    for group in range(24):
        # Each chain lies in a plane of its own label.
        axes = np.linalg.qr(rng.standard_normal((64, 2)))[0]
        rows += [(int(i), [float(x) for x in axes @ [np.cos(at * step), np.sin(at * step)]], group) for at, i in enumerate(10 * group + rng.permutation(6))]
    found = forest.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.component_id) for r in found} == {(i, 10 * g) for i, _, g in rows}
    assert sum(r.kept for r in found) == 24 and sum(r.n_links for r in found) == 24 * 10


def test_search_recall_and_edges(spark):
    table = [t[:2] for t in vectors(6, 800) if t[0] != 905]
    rows = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    found = pivots.search(rows, F.col("vec_id") % 20 == 0).toPandas()
    values = np.array([t[1] for t in table if t[0] < 800])
    units = values / np.sqrt((values**2).sum(axis=1))[:, None]
    hits = 0
    for q in range(0, 800, 20):
        score = units @ units[q]
        score[q] = -2
        best = np.lexsort((np.arange(800), -score))[:5]
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own["score"], score[own["vec_id"]])
        hits += len(set(best) & set(own["vec_id"]))
    assert hits / 200 >= 0.9
    assert set(found.query_id) == set(range(0, 800, 20))
    few = pivots.search(rows.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert pivots.search(rows.limit(0), F.lit(True)).count() == 0


def test_search_inside_a_large_group_of_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 16))
    table = [(i, base[0] if i % 3 else base[i % 400]) for i in range(3000)]
    table += [(5000 + i, base[1] * 2.0 ** (i % 7)) for i in range(700)]  # equal directions of different lengths
    rows = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in table], "vec_id long, embedding array<double>")
    found = pivots.search(rows, F.col("vec_id").isin(1, 2, 1501, 2999, 5006, 5600)).toPandas()
    ids, values = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    units = values / np.sqrt((values**2).sum(axis=1))[:, None]
    # 1501 is a copy of vector 0, as all ids that 3 does not divide, and 0 and 1200 and 2400, which 400 divides.
    group = [i for i, v in table if np.array_equal(v, base[0])]
    assert len(group) > 2000
    for q in (1, 2, 1501, 2999):
        assert found[found.query_id == q].sort_values("rank")["vec_id"].tolist() == [i for i in group if i != q][:5]
    for q in (5006, 5600):
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own["score"], 1) and q not in set(own["vec_id"])
        assert np.allclose(units[np.isin(ids, own["vec_id"])] @ units[ids == q][0], 1)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    rows = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# URLs


def brute_rule(host, path):
    best = None
    for name, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
        own, _, rest = name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    return best


def test_urls_equal_brute_force(spark):
    urls = ["http://WWW.Example.com/en/x?y#z", "https://example.com/en", "https://example.com/en/", "http://a.example.com/EN/", "x://net/es/1", "http://badnet/es/", "http://b.net/fr/?a", "http://com",
            "http://com/", "http://com?x", None, "", "no scheme", "://", "http://spam-farm.example.org/x", "http://notspam.example.org/", "http://a.org/p?PHPSESSID=1", "http://x.com://y.net/es/", "http://spam.example.com/de/",
            "http://a.org/a/login", "http://h.org/\nx", "http://a.net/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(99, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert len(rows) == len(urls) + 1
    for i, url in enumerate(urls):
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        best = brute_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best[0] if best else None), url
        if best:
            assert rows[i].verdict == best[1]
    assert [rows[i].verdict for i in (14, 15, 16, 18, 19)] == ["block", "allow", "block", "allow", "block"]
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://a.example.com/en/{i}",) for i in range(9)] + [("http://www.example.com/de/",)], "url string")
    keys = {r.rule: r.key for r in url_rules.index(urls, url_rules.RULES).collect()}
    assert keys["www.example.com/en/"] == "www" and keys["example.com/en/"] == "en"
    assert all(key in r.tokens for r in url_rules.RULES for key in [keys[r.name]])  # no rule is fetched by every URL


def test_patterns_run_only_where_their_literal_is(spark):
    urls = {
        "http://xxx.net": "block", "http://a-porn.b.org/x": "block", "http://h.org/a/login.php?x": "block", "http://h.org/signin": "block", "http://h.org/signin#top": "block",
        "http://xxxl.org/": "allow", "http://h.org/porn": "allow", "http://h.org/blogin/": "allow", "http://h.org/?u=/login": "allow", "http://login.org/": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    patterns = [r for r in url_rules.RULES if not r.listed]
    got = {r.url: r.verdict for r in url_rules.judge(pages, patterns).collect()}
    assert got == urls
    plain = {u: "block" if any(re.search(r.pattern, u.lower() if r.on == "url" else "//" + re.match(r"[^?#]*", u.split("://", 1)[1])[0]) for r in patterns) else "allow" for u in urls}
    assert got == plain


# Registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    rows = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    columns = queries.QUERIES[name](spark, SF).columns
    base = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = base.sql(queries.ORACLES[name]).to_df()[columns].astype(object)
    want = frame.where(frame.notna(), None).itertuples(index=False)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.land(stage(spark, docs, SF), name)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if name == "near_duplicates":
            ids = sorted(before)
            part = brute_components([before[i] for i in ids], 5, 80)[1]
            assert set(after) == {ids[p] for p in part}
        if name == "secrets":
            assert set(after) == set(before) and not any(base_spans(t or "") for t in after.values())
        docs = out
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
