"""Registered queries of this package, one per operator, over whole tables; SQL counterparts where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import bpe, collocations, elimination, forest, language, minhash, mixing, pivots, quality, secret_scan, token_files, url_rules, whitening
from marketflow.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.checksums(token_files.read(spark, folder))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.link(table(spark, sf_dir, "embeddings"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).drop("url", "reason")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), n=3, percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents")).drop("text", "n_chars")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    texts = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return language.predict(texts, model).drop("text")


def op10_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elimination.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.seen = l.a),
lowest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes z ON d.doc_id = z.doc_id JOIN lowest l ON d.doc_id = l.node
"""

OP4_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.seen = l.a),
lowest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON vec_id = node LEFT JOIN counts ON vec_id = a
"""


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest([w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM words, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.k, c.g, c.f AS a, h.k AS cut, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM counts c JOIN counts h ON h.lang = c.lang AND h.k < c.k AND h.g = c.g[1 : h.k] JOIN counts t ON t.lang = c.lang AND t.k = c.k - h.k AND t.g = c.g[h.k + 1 : c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, a, unnest(flatten([[g[i : i + m - 1] FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS g FROM best WHERE k > 2),
absorbing AS (SELECT lang, g, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN absorbing s ON s.lang = b.lang AND s.g = b.g
  WHERE s.longer IS NULL OR CAST(100 AS HUGEINT) * s.longer < CAST(80 AS HUGEINT) * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON k.lang = t.lang QUALIFY rank <= 2000
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op5_sql(rules: list[url_rules.Rule]) -> str:
    """Every rule against every URL: the longest listed rule decides, else any pattern of the method blocks."""
    listed = ", ".join(f"({', '.join(map(_quoted, (r.name, r.verdict, *r.name.partition('/')[::2])))})" for r in rules if r.listed)
    reads = {"url": "lower(url)", "host_path": "'//' || host || path"}
    patterns = " OR ".join(f"regexp_matches({reads[r.on]}, {_quoted(r.pattern)})" for r in rules if not r.listed)
    return f"""
WITH rules(rule, verdict, rule_host, rule_path) AS (VALUES {listed}),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM split JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, '/' || rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_forest": op4_forest,
    "op5_url_rules": op5_url_rules,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_language": op9_language,
    "op10_pivots": op10_pivots,
    "op11_elimination": op11_elimination,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op4_forest": OP4_SQL,
    "op5_url_rules": op5_sql(url_rules.RULES),
    "op6_minhash": OP6_SQL,
    "op11_elimination": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
