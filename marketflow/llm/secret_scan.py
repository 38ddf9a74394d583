"""Secret scans with DataFrame functions alone: fixed patterns, and a battery of randomness tests over long tokens.

Every part runs inside the JVM: regular expressions give the matches and, by the gaps between them, their places; the tests
are arithmetic over symbol arrays; the false-discovery threshold comes from a bounded histogram of scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns, their group to measure and its least length, in the order of their kinds.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
# Runs that can never fail their least length, so that short words are not matched at all.
QUICK = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
# Maximal runs only: the look-behind keeps a failing run from being tried again at each of its characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = [*BASE, "random"]
# Encodings in the order of inference: name, pattern, symbols in order.
ENCODINGS = [
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper36", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
# Expected share of discoveries that are ordinary text.
FALSE_DISCOVERY = 0.01
# Text model of the null hypothesis: probability that two symbols of ordinary words agree, and that neighbours in a name
# change between digit, lower case and upper case.
TEXT_REPEAT = 0.066
TEXT_CHANGE = 0.08
# Scores are binned at this many bins per power of ten, up to this power; the histogram therefore has a fixed size.
BINS_PER_TEN, TOP_TEN = 20, 60
SPAN = "array<struct<start:int,order:int,end:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in order with their places: array of (start, match), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    # Start of match i: all gaps up to i and all matches before it.
    pieces = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))
    return F.aggregate(
        pieces,
        start,
        lambda s, p: F.struct(
            (s["at"] + p["gap"] + F.length(p["match"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + p["gap"]).alias("start"), p["match"].alias("match")))).alias("out"),
        ),
    )["out"]


def _spans(text: Column, kind: str) -> Column:
    """Base spans of one kind: array of (start, end, kind); a text that holds none is not split."""
    pattern, group, least = BASE[kind]
    used = QUICK.get(kind, pattern)
    found = F.when(text.rlike(used), _matches(text, used))
    if group:
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["match"], pattern, group)) >= least)
    order = KINDS.index(kind)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), (m["start"] + F.length(m["match"])).alias("end")))
    return F.coalesce(spans, F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """-log10 of the upper tail of the normal distribution at z, by a closed bound that is on the safe (smaller) side."""
    y = F.greatest(z, F.lit(0.0))
    # P(Z > y) <= exp(-y*y/2) / 2, hence -log10 P is at least this.
    return (y * y / 2 + F.log(F.lit(2.0))) / F.log(F.lit(10.0)) * (z > 0).cast("double")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _tests(symbols: Column, code: Column) -> Column:
    """Scores of one token: its symbols, and its encoding with ``name`` and ``alphabet``."""
    k = F.length(code["alphabet"]).cast("double")
    n = F.size(symbols).cast("double")
    numeric = code["name"].isin("decimal", "hex", "hex_upper")

    def symbol_class(c: Column) -> Column:
        kind = F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
        return F.when(numeric, (F.position(c, code["alphabet"]) > k / 2).cast("int")).otherwise(kind)

    def scores(classes: Column) -> Column:
        counts = F.transform(F.array_distinct(symbols), lambda c: F.size(F.filter(symbols, lambda x: x == c)).cast("double"))
        chi = k / n * _sum(F.transform(counts, lambda o: o * o)) - n
        # Mean and spread of the statistic for text, where two symbols agree with probability ``repeat``.
        repeat = F.greatest(F.lit(TEXT_REPEAT), F.when(numeric, 2 / k).otherwise(0.0))
        chi_z = (k - 1 + (n - 1) * (repeat * k - 1) - chi) / (k * F.sqrt(2 * repeat * (1 - repeat)))
        rest = F.size(classes) - 1
        changes = _sum(F.zip_with(F.slice(classes, F.lit(1), rest), F.slice(classes, F.lit(2), rest), lambda a, b: (a != b).cast("double"))) / (n - 1)
        runs_z = (changes - TEXT_CHANGE) / F.sqrt(F.lit(TEXT_CHANGE * (1 - TEXT_CHANGE)) / (n - 1))
        # Correlation of neighbours' classes: changes against those of a shuffled token.
        shares = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.pow(F.size(F.filter(classes, lambda x: x == i)) / n, F.lit(2.0)))
        correlation = _let(1 - _sum(shares), lambda shuffled: F.when(shuffled > 0, 1 - changes / shuffled).otherwise(1.0))
        serial_z = (1 - 2 * TEXT_CHANGE - correlation) * F.sqrt(n - 1)
        return F.struct(_tail(chi_z).alias("chi"), _tail(runs_z).alias("runs"), _tail(serial_z).alias("serial"))

    return _let(F.transform(symbols, symbol_class), scores)


def battery(token: Column) -> Column:
    """``encoding``, the scores ``chi``, ``runs``, ``serial``, and ``score`` of a token of two or more symbols.

    The null hypothesis is ordinary text in the token's inferred alphabet. ``chi``: the chi-squared statistic of a uniform
    alphabet lies below what text of that length gives. ``runs``: more runs of symbol classes (digit, lower, upper, other; for
    digits of a base, its halves) than text has. ``serial``: neighbours' classes are not correlated as text's are. Each is
    -log10 of a bound of a tail probability; ``score`` is the second largest, so two tests must agree. A token of no encoding
    has score 0; a null token gives null scores.
    """
    code = F.coalesce(*[F.when(token.rlike(p), F.struct(F.lit(name).alias("name"), F.lit(letters).alias("alphabet"))) for name, p, letters in ENCODINGS])
    symbols = F.filter(F.split(F.rtrim(token, F.lit("=")), ""), lambda c: c != "")

    def result(found: Column) -> Column:
        tests = F.when(found["code"].isNotNull() & (F.size(found["symbols"]) > 1), _tests(found["symbols"], found["code"]))
        return _let(tests, lambda t: F.struct(
            found["code"]["name"].alias("encoding"), t["chi"].alias("chi"), t["runs"].alias("runs"), t["serial"].alias("serial"),
            F.coalesce(F.element_at(F.sort_array(F.array(t["chi"], t["runs"], t["serial"])), 2), F.lit(0.0)).alias("score"),
        ))

    return _let(F.struct(code.alias("code"), symbols.alias("symbols")), result)


def discovery_rule(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERY) -> tuple[float, float]:
    """(threshold, mean length) of the step-up false-discovery rule over all distinct candidate tokens of ``docs``.

    Length-aware: a token's p-value is divided by its length over the mean length, so that longer tokens, whose tests are
    stronger, get more of the error budget. The rule runs over a histogram with a fixed number of bins, rounded down, so that
    the threshold is never below the exact one; the two numbers are all that reaches the driver. Copies of a token count once.
    Without candidates the threshold is infinite.
    """
    found = docs.filter(F.col(text).rlike(CANDIDATE)).select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)))).alias("token"))
    scored = found.distinct().select(F.length("token").alias("length"), battery(F.col("token"))["score"].alias("score"))
    # One pass: weights need the mean length, which is a factor common to all tokens, so bins are taken before it is known.
    raw = scored.groupBy("length", F.floor(F.least(F.col("score"), F.lit(float(TOP_TEN))) * BINS_PER_TEN).alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    sized = raw.withColumn("mean", F.sum(F.col("length") * F.col("n")).over(total) / F.sum("n").over(total)).withColumn("all", F.sum("n").over(total))
    weighted = sized.withColumn("weighted", F.floor(F.greatest(F.lit(0.0), F.col("bin") + BINS_PER_TEN * F.log10(F.col("length") / F.col("mean")))))
    steps = weighted.groupBy("weighted", "mean", "all").agg(F.sum("n").alias("n")).withColumn("reached", F.sum("n").over(Window.orderBy(F.desc("weighted"))))
    passing = steps.filter(F.pow(F.lit(10.0), -F.col("weighted") / BINS_PER_TEN) <= F.lit(rate) * F.col("reached") / F.col("all"))
    row = passing.agg(F.min("weighted").alias("bin"), F.first("mean").alias("mean")).first()
    return (row["bin"] / BINS_PER_TEN, float(row["mean"])) if row["bin"] is not None else (float("inf"), 1.0)


def scan(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """Add ``secret_spans`` to ``docs``: array of (start, order, end), by start, then kind (``order`` is its place in ``KINDS``).

    Places count code points, ends are exclusive. Base spans are whole matches. Null and empty texts have none. Rows, repeated
    ones included, stay as they are; an input column of that name is replaced. A random span that overlaps a base span is left
    out. The texts are scanned twice and never shuffled: first for the false-discovery rule, then for the spans.
    """
    rest = docs.drop("secret_spans")
    threshold, mean = discovery_rule(rest, text, rate)
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_spans(whole, kind) for kind in BASE])
    if threshold == float("inf"):
        return rest.withColumn("secret_spans", F.array_sort(base))

    def marked(found: Column) -> Column:
        likely = F.filter(_matches(whole, CANDIDATE), lambda m: battery(m["match"])["score"] + F.log10(F.length(m["match"]) / F.lit(mean)) >= threshold)
        spans = F.transform(likely, lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE)).alias("order"), (m["start"] + F.length(m["match"])).alias("end")))
        free = F.filter(spans, lambda s: ~F.exists(found, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.array_sort(F.concat(found, F.when(whole.rlike(CANDIDATE), free).otherwise(F.array().cast(SPAN))))

    return rest.withColumn("secret_spans", _let(base, marked))


def described(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, a digest of them, and all spans."""
    spans = F.col("secret_spans")
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secret_spans")

    def count(order: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    digest = F.sha2(described(F.filter(spans, lambda s: s["order"] < len(BASE))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, described(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans are replaced together, other text stays.

    ``n_chars``, if there, becomes the new length of a changed text. No row is dropped.
    """
    found = scan(docs)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        before = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        new = F.when(span["start"] >= s["at"], F.concat(s["out"], before, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), new.alias("out"))

    clean = F.aggregate("secret_spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = F.size("secret_spans") > 0
    out = found.withColumn("_clean", F.when(changed, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("_clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("_clean")).select(*docs.columns)
