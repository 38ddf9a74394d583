"""As-of and interval joins, funds, ladders, quotes, percentiles and error statistics on star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.functions import stats as ST
from marketflow.operators import fit as FT
from marketflow.operators import funds as FU
from marketflow.operators import ladder as LD
from marketflow.operators import percentiles as PC
from marketflow.operators import temporal as TP
from marketflow.operators.scan import top_rows
from marketflow.plans import derive as D
from marketflow.plans.twins.base import BOOK, book_rows
from marketflow.plans.twins.common import INTENTS, META, ORDERS, n, plain, r, sql, student_t_sql


def asof_value(spark, root):
    """Latest login-like event (a view) of the same user at or before each purchase."""
    ev = D.table(spark, root, "events")
    left = ev.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = ev.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value", F.col("event_id").alias("view_id"))
    out = TP.asof_join(left, right, ["user_id"], "ts", "seen", ["value", "view_id"], tie="view_id")
    return plain(out.select("event_id", "user_id", "asof.value", "asof.view_id"))


def asof_null_value(spark, root):
    """As-of lookup in which a stored NULL is found and hides older values."""
    ev = D.table(spark, root, "events")
    left = ev.filter("event_type = 'error'").select("user_id", "event_id", "ts")
    right = ev.filter("event_type = 'click'").select("user_id", F.col("ts").alias("seen"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"))
    out = TP.asof_join(left, right, ["user_id"], "ts", "seen", ["value"], allow_equal=False)
    return plain(out.select("event_id", F.col("asof").isNotNull().alias("found"), "asof.value"))


def _ticks(spark, root):
    o = D.orders(spark, root).filter("c % 97 < 10")
    size = F.when(F.col("c") % 3 == 0, F.lit(None)).otherwise(3 + F.col("c") % 13).cast("int")
    rows = o.select(D.div("k", 10).alias("ledger_index"), D.tagged("I", F.col("u") % 3).alias("account"), "k", size.alias("tick_size"))
    last = rows.groupBy("ledger_index", "account").agg(F.max_by("tick_size", "k").alias("tick_size"))
    return last


def tick_size_asof(spark, root):
    rows = D.orders(spark, root).select("k", D.div("k", 10).alias("ledger_index"), D.tagged("I", (F.col("u") + 1) % 3).alias("account"))
    return plain(TP.tick_size_asof(rows, _ticks(spark, root), "account", "tick").select("k", "tick"))


def effective_tick_size(spark, root):
    return plain(TP.effective_tick_size(D.intents(spark, root), _ticks(spark, root)).select("tx_hash", "tick_size"))


def rate_interval(spark, root):
    """Order price range in force at each order, ranges made by change detection per customer."""
    o = D.orders(spark, root)
    level = o.select("u", F.col("k").alias("at"), "k", (F.col("c") % 3).alias("level"))
    ranges = TP.change_ranges(level.filter("at % 2 = 0"), ["u"], "at", "level", tie="k")
    asked = o.select("u", F.col("k").alias("at"))
    hit = TP.interval_join(asked, ranges, ["u"], "at", "first", "last", ["level"], disjoint=True)
    return plain(hit.select("at", "hit.level"))


def change_ranges(spark, root):
    o = D.orders(spark, root).select("u", F.col("k").alias("at"), "k", (F.col("c") % 2).alias("level"))
    return plain(TP.change_ranges(o, ["u"], "at", "level", tie="k"))


def rate_join(spark, root):
    """Overlapping rate ranges with a static fallback; the earliest start wins."""
    o = D.orders(spark, root)
    rows = o.select("k", D.div("k", 10).alias("ledger_index"), F.when(F.col("k") % 9 == 0, "XRP").otherwise(D.tagged("T", F.col("u") % 7)).alias("currency"), D.tagged("I", F.col("u") % 3).alias("issuer"))
    start = D.div("k", 10)
    ranges = o.filter("c % 50 = 0").select(D.tagged("T", F.col("u") % 7).alias("currency"), D.tagged("I", F.col("u") % 3).alias("issuer"), start.alias("first_ledger"), (start + F.col("c") % 7).alias("last_ledger"), (F.lit(1_000_000_000) + F.col("k")).alias("transfer_rate"))
    unique = ranges.groupBy("currency", "issuer", "first_ledger").agg(F.max("last_ledger").alias("last_ledger"), F.max("transfer_rate").alias("transfer_rate"))
    static = o.filter("c % 7 > 1").groupBy(D.tagged("T", F.col("u") % 7).alias("currency"), D.tagged("I", F.col("u") % 3).alias("issuer")).agg((F.lit(1_000_000_000) + F.count(F.lit(1))).alias("transfer_rate"))
    return plain(TP.rate_join(rows, unique, static, strict=False).select("k", "transfer_rate"))


def rate_changes(spark, root):
    return plain(TP.rate_changes(D.metadata_heads(spark, root)))


def rate_ranges(spark, root):
    """Rates of all issuers of the intents' assets over all their ledgers, from every setting in the records."""
    targets = D.intents(spark, root)
    changes = TP.rate_changes(D.metadata_heads(spark, root))
    issuers = targets.select(F.explode(F.array("in_issuer", "out_issuer")).alias("issuer"))
    return plain(TP.rate_ranges(targets, changes, TP.bound_rates(issuers, changes, TP.ledger_bounds(targets))))


def boundary(spark, root):
    """Total of the day before, exactly."""
    o = D.table(spark, root, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("bigint").alias("day"), "o_orderkey")
    totals = o.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return TP.attach_boundary(o.select("o_orderkey", "day"), totals, [], "day", ["n"]).select("o_orderkey", "n", "has_boundary")


def order_gaps(spark, root):
    li = D.table(spark, root, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return plain(TP.check_order(li, "l_orderkey", "l_linenumber", start=1))


def order_violations(spark, root):
    rows = D.table(spark, root, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return TP.order_violations(rows, "event_id", "user_id", "k")


def funds_alloc(spark, root):
    """Customer balances spent on their orders, largest first."""
    c = D.table(spark, root, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_acctbal") * 100).cast("decimal(18,0)").alias("funds"))
    o = D.orders(spark, root).select("k", F.col("u").alias("owner"), F.col("c").cast("decimal(18,0)").alias("size"), (F.col("k") % 17 == 0).alias("free"))
    rows = o.join(c.withColumn("funds", F.col("funds") * 50), "owner")
    return plain(FU.allocate_funds(rows, ["owner"], ["-size", "k"], unlimited="free", gate=o).select("k", "allocated"))


def funds_alloc_fee(spark, root):
    """The same with an owner fee of a quarter on each unit given."""
    c = D.table(spark, root, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_acctbal") * 100).alias("funds"))
    o = D.orders(spark, root).select("k", F.col("u").alias("owner"), (F.col("c") / 100).alias("size"))
    out = FU.allocate_funds(o.join(c, "owner"), ["owner"], ["size", "k"], rate=F.lit(1.25), gate=o)
    pays = FU.input_for_output(F.col("allocated"), F.col("size"), F.col("size") * 2, F.lit(2.0))
    return plain(out.select("k", "allocated", pays.alias("pays")), 2)


def funded_caps(spark, root):
    """Caps of two accounts per ledger served in sequence order."""
    o = D.orders(spark, root).select(D.div("k", 10).alias("ledger_index"), (F.col("u") % 2).alias("account"), F.col("k").alias("sequence"), "c", "k")
    listed = o.filter("k % 3 <> 0").select("ledger_index", "account", "sequence", D.tagged("B", F.col("k")).alias("offer_id"), F.when(F.col("k") % 4 == 0, F.floor(F.col("c") / 2)).otherwise(F.col("c")).alias("size"), F.lit(60_000_000).alias("funds"))
    out = FU.funded_caps(listed, o.select("ledger_index", "account", "sequence", F.col("c").alias("size")), key=["ledger_index", "account"])
    return plain(out.select("ledger_index", "account", "offer_id", "cap"))


def owner_floor(spark, root):
    c = D.table(spark, root, "customer").select("c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("kind"))
    return plain(FU.owner_floor(c, ["c_nationkey"], funds="c_acctbal"))


def apply_owner_floor(spark, root):
    c = D.table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit("one").alias("kind"))
    return plain(FU.apply_owner_floor(c, ["c_nationkey"], funds="c_acctbal").select("c_custkey", "c_acctbal", "conflict"))


def funds_by_account(spark, root):
    return FU.funds_by_account(book_rows(spark, root), ["account"])


def effective_fee(spark, root):
    swaps = D.swaps(spark, root).select("tx_hash", "asset_in_currency", "asset_in_value")
    out = FU.effective_fee(swaps.join(D.fees(spark, root), "tx_hash"))
    return plain(out.select("tx_hash", "fee_units", F.coalesce("fee_problem", F.lit("ok")).alias("fee_problem")))


def _line_offers(spark, root):
    li = D.table(spark, root, "lineitem")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("double") / 100
    tie = F.concat_ws("-", "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return li.select("l_partkey", F.col("l_quantity").alias("size"), price.alias("price"), tie.alias("tie"))


def depth_ladder(spark, root):
    offers = _line_offers(spark, root)
    out = LD.depth_ladder(offers, ["l_partkey"], ["price", "tie"], "size", total=F.lit(60.0), gate=offers)
    return plain(out.select("l_partkey", "tie", "before", "after", "interval_lo", "interval_hi"))


def depth_fill(spark, root):
    offers = _line_offers(spark, root)
    ladder = LD.depth_ladder(offers, ["l_partkey"], ["price", "tie"], "size", gate=offers)
    wants = D.table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("request"), (F.col("p_size") * 10).cast("double").alias("want"))
    return plain(LD.fill_from_ladder(wants, ladder, ["l_partkey"], "request"))


def pool_quote(spark, root):
    """Pool of each order's customer quoted for each order."""
    o = D.orders(spark, root)
    states = o.select("k", (F.col("c") * 100).cast("double").alias("reserve_in"), (F.col("u") + 1).cast("double").alias("reserve_out"), (F.col("c") % 5000).cast("double").alias("amount_in"), ((F.col("u") + 1) * (F.col("k") % 11) / 10).alias("amount_out"), (F.col("k") % 1001).alias("fee_units"))
    return plain(LD.quote_pool(states).select("k", "quoted_out", "quoted_in", "spot_price"), 3)


def pool_quote_asof(spark, root):
    """Requests quoted against the latest earlier pool state of their token."""
    o = D.orders(spark, root)
    token = D.tagged("T", F.col("u") % 7)
    states = o.filter("k % 3 = 0").select(token.alias("token"), F.col("k").alias("at"), F.col("c").cast("double").alias("reserve_in"), (F.col("c") * 2).cast("double").alias("reserve_out"))
    asked = o.filter("k % 3 <> 0").select("k", token.alias("token"), (F.col("c") % 1000).cast("double").alias("amount_in"), F.lit(10.0).alias("amount_out"), F.lit(300).alias("fee_units"))
    joined = TP.asof_join(asked, states, ["token"], "k", "at", ["reserve_in", "reserve_out"]).select("*", "asof.*").drop("asof")
    return plain(LD.quote_pool(joined).select("k", "quoted_out"), 3)


def book_rank(spark, root):
    offers = _line_offers(spark, root)
    return plain(LD.rank_book(offers, ["l_partkey"], quality="price", position="tie", n=5).select("l_partkey", "tie", "book_rank"))


def book_rank_all(spark, root):
    book = book_rows(spark, root).withColumn("quality", F.col("c") % 1000)
    return plain(LD.rank_book(book, ["ledger_index", "side"]).select("offer_id", "book_rank"))


def book_quality(spark, root):
    """Encoded quality, decoded rate and tick rounding of every offer."""
    from marketflow.functions import amounts as A

    book = book_rows(spark, root)
    rounded = A.round_to_tick("cast(c * 1000000000 as decimal(38,0))", "cast(3 + k % 14 as int)")
    return book.select("offer_id", A.book_quality(F.col("book_directory")).cast("string").alias("quality"), (F.round(A.book_rate(F.col("book_directory")) * 1e21, 3) + F.lit(0.0)).alias("rate_e21"), rounded.cast("string").alias("rounded"))


def amounts_parsed(spark, root):
    """Exact units and exponents of raw offer amounts."""
    from marketflow.functions import amounts as A

    book = book_rows(spark, root).withColumn("amount", A.parse_amount("taker_gets"))
    return book.select("offer_id", "amount.currency", F.col("amount.units").cast("string").alias("units"), F.col("amount.exponent").cast("bigint").alias("exponent"), "amount.inexact")


def _compared(spark, root):
    li = D.table(spark, root, "lineitem")
    retail = D.table(spark, root, "part").select("p_partkey", "p_retailprice")
    joined = li.join(retail, li["l_partkey"] == retail["p_partkey"])
    return joined.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice", F.round(F.col("l_quantity") * F.col("p_retailprice"), 2).alias("model"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("real"), F.when(F.col("l_suppkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("model_out"), F.when(F.col("l_suppkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("l_quantity") * (1 + F.when(F.col("l_partkey") % 3 == 0, 0.0).when(F.col("l_partkey") % 3 == 1, 1e-10).otherwise(1e-13))).alias("real_out"))


def rel_error(spark, root):
    rows = _compared(spark, root)
    return plain(rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", ST.relative_error(F.col("model"), F.col("real")).alias("rel"), ST.relative_error(F.col("model"), F.col("real"), signed=True).alias("signed")))


def totals_error(spark, root):
    """Errors of both sides' totals per order and the larger defined one."""
    per = _compared(spark, root).groupBy("l_orderkey").agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(a) for c, a in (("model", "model_total_in"), ("real", "real_total_in"), ("l_extendedprice", "model_total_out"))]).withColumn("real_total_out", F.col("model_total_out") + F.col("l_orderkey") % 3)
    return plain(FT.with_relative_errors(per).select("l_orderkey", "in_rel_err", "out_rel_err", "max_rel_err", "out_signed_rel_err"))


def error_hist(spark, root):
    rows = _compared(spark, root).withColumn("err", ST.relative_error(F.col("model_out"), F.col("real_out")))
    return plain(FT.error_histogram(rows, ["l_returnflag"], "err"))


def cumulative_hist(spark, root):
    rows = _compared(spark, root).withColumn("err", ST.relative_error(F.col("model_out"), F.col("real_out")))
    return plain(FT.cumulative_histogram(FT.error_histogram(rows, ["l_returnflag"], "err"), ["l_returnflag"]).drop("line"))


def moments(spark, root):
    return plain(FT.moments(D.table(spark, root, "lineitem").withColumn("v", F.nullif("l_discount", F.lit(0.0))), ["l_suppkey"], "v"), 5)


def t_stat(spark, root):
    li = D.table(spark, root, "lineitem").withColumn("gap", F.col("l_discount") - 0.05)
    return plain(FT.t_test(li, ["l_returnflag"], "gap").select("l_returnflag", "n", "df", "mean", "stddev", "t_stat"), 4)


def t_test_p(spark, root):
    """Full test with p-value and decision."""
    li = D.table(spark, root, "lineitem").withColumn("gap", F.col("l_discount") - 0.05)
    return plain(FT.t_test(li, ["l_suppkey"], "gap"), 6)


def pct_nearest(spark, root):
    rows = D.table(spark, root, "lineitem").select("l_suppkey", "l_extendedprice")
    return plain(PC.percentile_nearest(rows, ["l_suppkey"], "l_extendedprice", [5, 50, 90, 95, 99]))


def pct_linear(spark, root):
    p = D.table(spark, root, "part").select("p_brand", "p_retailprice")
    return plain(PC.percentile_linear(p, ["p_brand"], "p_retailprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}), 4)


def pct_ceil(spark, root):
    p = D.table(spark, root, "part").select("p_brand", "p_retailprice")
    return plain(PC.percentile_ceil(p, ["p_brand"], "p_retailprice", {"c50": 0.5, "c95": 0.95, "c99": 0.99}))


def topk(spark, root):
    p = D.table(spark, root, "part").select("p_brand", "p_partkey", "p_retailprice")
    return plain(top_rows(p, ["p_brand"], ["-p_retailprice", "p_partkey"], 3))


def amount_only(spark, root):
    """Range of the smallest ordered gaps per segment, with the completeness flag."""
    o = D.table(spark, root, "orders").select(F.col("o_orderpriority").alias("pair"), F.col("o_orderkey").cast("string").alias("tx_hash"), F.round(F.col("o_totalprice") % 1000, 2).alias("err"))
    expected = o.groupBy("pair").agg((F.count(F.lit(1)) + F.when(F.col("pair") == "5-LOW", 10).otherwise(-7)).alias("expected_count"))
    return plain(FT.amount_only_range(o, ["pair"], "err", expected), 4)


UNIT = "floor(l_extendedprice / l_quantity * 100) / 100"
TIE = "l_orderkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_extendedprice"
OFFERS = f"q AS (SELECT l_partkey, l_quantity size, {UNIT} price, {TIE} tie FROM lineitem), w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_partkey ORDER BY price, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM q)"
TICKS = "t0 AS (SELECT k // 10 li, 'I' || (u % 3) account, k, CASE WHEN c % 3 = 0 THEN NULL ELSE 3 + c % 13 END sz FROM o WHERE c % 97 < 10), tk AS (SELECT li, account, (max(struct_pack(k := k, sz := sz))).sz sz, true f FROM t0 GROUP BY 1, 2)"
RUNS = lambda where, mod: (
    f"l AS (SELECT u, k, c % {mod} lv FROM o {where}), g AS (SELECT *, CASE WHEN lag(lv) OVER (PARTITION BY u ORDER BY k) = lv THEN 0 ELSE 1 END nw FROM l), "
    "h AS (SELECT *, sum(nw) OVER (PARTITION BY u ORDER BY k) run FROM g), s AS (SELECT u, run, min(k) f, max(k) m, min(lv) lv, count(*) n FROM h GROUP BY 1, 2), "
    "z AS (SELECT u, f, CASE WHEN lead(f) OVER (PARTITION BY u ORDER BY run) IS NULL THEN m ELSE greatest(lead(f) OVER (PARTITION BY u ORDER BY run) - 1, f) END l, lv, n FROM s)"
)
COMPARED = (
    "cp AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_extendedprice, round(l_quantity * p_retailprice, 2) model, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 ELSE l_extendedprice END AS rl, "
    "CASE WHEN l_suppkey % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END mo, CASE WHEN l_suppkey % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity * (1 + CASE l_partkey % 3 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(1e-10 AS DOUBLE) ELSE CAST(1e-13 AS DOUBLE) END) END ro FROM lineitem JOIN part ON p_partkey = l_partkey)"
)
BUCKET = "CASE WHEN e IS NULL THEN 'undefined(real=0, model!=0)' WHEN e = 0 THEN '=0' WHEN e <= CAST(1e-15 AS DOUBLE) THEN '<= 1e-15' WHEN e <= CAST(1e-14 AS DOUBLE) THEN '<= 1e-14' WHEN e <= CAST(1e-13 AS DOUBLE) THEN '<= 1e-13' WHEN e <= CAST(1e-12 AS DOUBLE) THEN '<= 1e-12' WHEN e <= CAST(1e-9 AS DOUBLE) THEN '<= 1e-9' ELSE '> 1e-9' END"
BUCKET_RANK = "CASE bucket WHEN '=0' THEN 0 WHEN '<= 1e-15' THEN 1 WHEN '<= 1e-14' THEN 2 WHEN '<= 1e-13' THEN 3 WHEN '<= 1e-12' THEN 4 WHEN '<= 1e-9' THEN 5 WHEN '> 1e-9' THEN 6 ELSE 7 END"
ERRS = f"{COMPARED}, er AS (SELECT l_returnflag, CASE WHEN ro = 0 THEN CASE WHEN mo = 0 THEN 0 END ELSE abs(mo - ro) / abs(ro) END e FROM cp), hb AS (SELECT l_returnflag, {BUCKET} bucket, count(*) n FROM er GROUP BY 1, 2), hr AS (SELECT *, {BUCKET_RANK} rk FROM hb)"
rel = lambda m, t, s="abs": f"CASE WHEN {t} = 0 THEN CASE WHEN {m} = 0 THEN 0 END ELSE {s}({m} - {t}) / abs({t}) END"

TWINS = {
    "asof_value": (asof_value, f"WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value, event_id view_id FROM events WHERE event_type = 'view') SELECT p.event_id, p.user_id, {r('v.value')} AS value, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"),
    "asof_null_value": (asof_null_value, f"WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), v AS (SELECT user_id, ts, CASE WHEN event_id % 2 = 0 THEN value END val, true f FROM events WHERE event_type = 'click') SELECT p.event_id, coalesce(v.f, false) AS found, {r('v.val')} AS value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts"),
    "tick_size_asof": (tick_size_asof, sql(ORDERS, f", {TICKS}, a AS (SELECT k, k // 10 li, 'I' || ((u + 1) % 3) account FROM o) SELECT a.k, {n('tk.sz')} tick FROM a ASOF LEFT JOIN tk ON a.account = tk.account AND a.li >= tk.li")),
    "effective_tick_size": (effective_tick_size, sql(INTENTS, f", {TICKS}, a AS (SELECT tx, li, iss account, offer FROM it) SELECT a.tx tx_hash, {n('CASE WHEN offer THEN tk.sz END')} tick_size FROM a ASOF LEFT JOIN tk ON a.account = tk.account AND a.li >= tk.li")),
    "rate_interval": (rate_interval, sql(ORDERS, f", {RUNS('WHERE k % 2 = 0', 3)} SELECT k AS at, lv AS level FROM o LEFT JOIN z ON z.u = o.u AND o.k BETWEEN z.f AND z.l")),
    "change_ranges": (change_ranges, sql(ORDERS, f", {RUNS('', 2)} SELECT u, f AS first, l AS last, lv AS level, n FROM z")),
    "rate_join": (rate_join, sql(ORDERS, ", a AS (SELECT k, k // 10 li, CASE WHEN k % 9 = 0 THEN 'XRP' ELSE 'T' || (u % 7) END cur, 'I' || (u % 3) iss FROM o), rg AS (SELECT 'T' || (u % 7) cur, 'I' || (u % 3) iss, k // 10 f, max(k // 10 + c % 7) l, max(1000000000 + k) rt FROM o WHERE c % 50 = 0 GROUP BY 1, 2, 3), "
        "st AS (SELECT 'T' || (u % 7) cur, 'I' || (u % 3) iss, 1000000000 + count(*) rt FROM o WHERE c % 7 > 1 GROUP BY 1, 2), "
        "hit AS (SELECT a.k, arg_min(rg.rt, rg.f) rt FROM a JOIN rg ON a.cur = rg.cur AND a.iss = rg.iss AND a.li BETWEEN rg.f AND rg.l GROUP BY 1) "
        f"SELECT a.k, {n('CASE WHEN a.cur = ' + chr(39) + 'XRP' + chr(39) + ' THEN 1000000000 ELSE coalesce(hit.rt, st.rt) END')} transfer_rate FROM a LEFT JOIN hit ON hit.k = a.k LEFT JOIN st ON st.cur = a.cur AND st.iss = a.iss")),
    "rate_changes": (rate_changes, sql(META, "SELECT iss issuer, li ledger_index, ti transaction_index, tx tx_hash, 1000000000 + (k % 50) * 1000000 transfer_rate FROM m WHERE NOT pay AND NOT offer")),
    "rate_ranges": (rate_ranges, sql(INTENTS, ", b AS (SELECT min(li) f, max(li) l FROM it), ch AS (SELECT iss, li, ti, tx, 1000000000 + (k % 50) * 1000000 rt FROM m WHERE NOT pay AND NOT offer), "
        "ks AS (SELECT DISTINCT iss FROM (SELECT iiss iss FROM it UNION ALL SELECT oiss FROM it) WHERE iss IS NOT NULL), "
        "rt AS (SELECT ks.iss, coalesce(arg_max(rt, (li, ti)) FILTER (li < f), 1000000000) s, coalesce(arg_max(rt, (li, ti)) FILTER (li <= l), 1000000000) e FROM ks LEFT JOIN ch USING (iss), b GROUP BY 1), "
        "ins AS (SELECT ch.* FROM ch JOIN ks USING (iss), b WHERE li BETWEEN f AND l), cn AS (SELECT iss, count(*) n FROM ins GROUP BY 1), "
        "ob AS (SELECT iss, f li, -1 ti, NULL tx, s rt FROM rt, b UNION ALL SELECT iss, li, ti, tx, rt FROM ins), "
        "bg AS (SELECT * FROM (SELECT *, lag(rt) OVER (PARTITION BY iss ORDER BY li, ti) p FROM ob) WHERE ti < 0 OR p <> rt), "
        "nx AS (SELECT *, lead(li) OVER w nl, lead(ti) OVER w ni FROM bg WINDOW w AS (PARTITION BY iss ORDER BY li, ti)), "
        "q AS (SELECT nx.*, s, l, coalesce(n, 0) n, CASE WHEN coalesce(n, 0) > 0 THEN 'changed_inside' WHEN s <> e THEN 'ends_differ' ELSE 'single' END status FROM nx JOIN rt USING (iss) LEFT JOIN cn USING (iss), b) "
        f"SELECT iss issuer, li first_ledger, {n('ti')} first_index, coalesce(nl, l) last_ledger, {n('ni')} last_index, tx tx_hash, n n_changes, status, CASE WHEN status <> 'ends_differ' THEN rt END transfer_rate FROM q")),
    "boundary": (boundary, "WITH q AS (SELECT o_orderkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) dy FROM orders), t AS (SELECT dy, count(*) n FROM q GROUP BY 1) SELECT o_orderkey, t.n, t.n IS NOT NULL has_boundary FROM q LEFT JOIN t ON t.dy = q.dy - 1"),
    "order_gaps": (order_gaps, f"WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), w AS (SELECT *, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) e FROM q) SELECT l_orderkey, {n('e')} expected, {n('l_linenumber')} AS found FROM w WHERE e <> l_linenumber"),
    "order_violations": (order_violations, "WITH q AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events), w AS (SELECT *, lag(user_id) OVER (ORDER BY event_id) pu, lag(k) OVER (ORDER BY event_id) pk FROM q) SELECT event_id, user_id, k, pu previous_group, pk previous_index FROM w WHERE user_id < pu OR (user_id = pu AND k < pk)"),
    "funds_alloc": (funds_alloc, sql(ORDERS, f", q AS (SELECT k, u, c, k % 17 = 0 free, CAST(round(c_acctbal * 100) AS BIGINT) * 50 f FROM o JOIN customer ON c_custkey = u), w AS (SELECT *, coalesce(sum(CASE WHEN free THEN 0 ELSE c END) OVER (PARTITION BY u ORDER BY c DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM q) SELECT k, {r('CASE WHEN free THEN c ELSE least(c, greatest(f - b, 0)) END')} allocated FROM w")),
    "funds_alloc_fee": (funds_alloc_fee, sql(ORDERS, f", q AS (SELECT k, u, CAST(c AS DOUBLE) / 100 sz, c_acctbal * 100 f FROM o JOIN customer ON c_custkey = u), w AS (SELECT *, coalesce(sum(sz * 1.25) OVER (PARTITION BY u ORDER BY sz, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM q), x AS (SELECT *, least(sz, greatest(f - b, 0) / 1.25) a FROM w) SELECT k, {r('a', 2)} allocated, {r('CASE WHEN a < sz THEN least(sz * 2, a * 2) ELSE sz * 2 END', 2)} pays FROM x")),
    "funded_caps": (funded_caps, f"WITH RECURSIVE {ORDERS}, q AS (SELECT k // 10 li, u % 2 acc, k, c, k % 3 <> 0 inb, CASE WHEN k % 4 = 0 THEN c // 2 ELSE c END bs, row_number() OVER (PARTITION BY k // 10, u % 2 ORDER BY k) rn FROM o), "
        "f AS (SELECT *, CAST(60000000 AS BIGINT) lft FROM q WHERE rn = 1 UNION ALL SELECT q.*, CASE WHEN NOT f.inb OR f.bs >= least(f.c, f.lft) THEN greatest(f.lft - least(f.c, f.lft), 0) ELSE f.lft END FROM f JOIN q ON q.li = f.li AND q.acc = f.acc AND q.rn = f.rn + 1) "
        f"SELECT li ledger_index, acc account, 'B' || k offer_id, {r('least(c, lft)')} cap FROM f WHERE inb AND bs >= least(c, lft)"),
    "owner_floor": (owner_floor, f"SELECT {n('c_nationkey')} c_nationkey, {r('min(c_acctbal) FILTER (c_acctbal > 0)')} floor, true has_funds, coalesce(min(c_mktsegment) FILTER (c_acctbal > 0) <> max(c_mktsegment) FILTER (c_acctbal > 0), false) conflict FROM customer GROUP BY 1"),
    "apply_owner_floor": (apply_owner_floor, f"SELECT c_custkey, {r('coalesce(min(CASE WHEN c_acctbal > 0 THEN c_acctbal END) OVER (PARTITION BY c_nationkey), c_acctbal)')} c_acctbal, false conflict FROM customer"),
    "funds_by_account": (funds_by_account, sql(BOOK, "SELECT DISTINCT account FROM bk WHERE k % 7 = 0")),
    "effective_fee": (effective_fee, sql(ORDERS, ", q AS (SELECT k, k % 10 lv, k % 4 turn FROM o), w AS (SELECT *, CASE WHEN turn <> 2 AND k % 11 = 0 THEN 'fee_currency_mismatch' WHEN turn = 3 AND lv > 0 THEN 'fee_not_explained' ELSE 'ok' END p FROM q) SELECT 'a' || k tx_hash, CASE WHEN p = 'ok' THEN CASE WHEN turn = 1 THEN lv * 10 ELSE lv * 100 END END fee_units, p fee_problem FROM w")),
    "depth_ladder": (depth_ladder, f"WITH {OFFERS} SELECT l_partkey, tie, {r('b')} AS before, {r('b + size')} AS after, {r('greatest(0, 60 - b - size)')} interval_lo, {r('least(60, 60 - b)')} interval_hi FROM w WHERE b < 60"),
    "depth_fill": (depth_fill, f"WITH {OFFERS}, q2 AS (SELECT p_partkey, p_size * 10.0 want FROM part), t AS (SELECT p_partkey, want, price, greatest(0, least(size, want - b)) tk FROM q2 JOIN w ON l_partkey = p_partkey), f AS (SELECT p_partkey, sum(tk) f, sum(tk * price) c, count(*) n, max(price) wp FROM t WHERE tk > 0 GROUP BY 1) "
        f"SELECT q2.p_partkey request, {r('want')} want, {r('coalesce(f, 0)')} filled, {r('coalesce(c, 0)')} AS cost, {r('c / f')} avg_price, coalesce(n, 0) offers_used, {r('wp')} worst_price, coalesce(f, 0) < want is_partial FROM q2 LEFT JOIN f ON f.p_partkey = q2.p_partkey"),
    "pool_quote": (pool_quote, sql(ORDERS, ", q AS (SELECT k, CAST(c * 100 AS DOUBLE) x, CAST(u + 1 AS DOUBLE) y, CAST(c % 5000 AS DOUBLE) ai, CAST((u + 1) * (k % 11) AS DOUBLE) / 10 ao, 1 - CAST(k % 1001 AS DOUBLE) / 100000 g FROM o) "
        f"SELECT k, {r('CASE WHEN ai > 0 THEN greatest(y - x * y / (x + ai * g), 0) ELSE 0 END', 3)} quoted_out, {r('CASE WHEN ao > 0 AND ao < y THEN greatest((x * y / (y - ao) - x) / g, 0) ELSE 0 END', 3)} quoted_in, {r('x / y', 3)} spot_price FROM q")),
    "pool_quote_asof": (pool_quote_asof, sql(ORDERS, ", s AS (SELECT 'T' || (u % 7) t, k, CAST(c AS DOUBLE) x, CAST(c * 2 AS DOUBLE) y FROM o WHERE k % 3 = 0), a AS (SELECT k, 'T' || (u % 7) t, CAST(c % 1000 AS DOUBLE) ai FROM o WHERE k % 3 <> 0) "
        f"SELECT a.k, {r('CASE WHEN ai > 0 AND x > 0 THEN greatest(y - x * y / (x + ai * (1 - 0.003)), 0) ELSE 0 END', 3)} quoted_out FROM a ASOF LEFT JOIN s ON a.t = s.t AND a.k >= s.k")),
    "book_rank": (book_rank, f"WITH q AS (SELECT l_partkey, {UNIT} price, {TIE} tie FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY price, tie) rk FROM q) SELECT l_partkey, tie, rk book_rank FROM w WHERE rk <= 5"),
    "book_rank_all": (book_rank_all, sql(BOOK, "SELECT offer_id, row_number() OVER (PARTITION BY li, side ORDER BY q, pos) book_rank FROM bk")),
    "book_quality": (book_quality, sql(BOOK, "SELECT offer_id, CAST(CAST(5692549928996306944 AS HUGEINT) + q AS VARCHAR) quality, " + r("CAST(q AS DOUBLE)", 3) + " rate_e21, CAST(CASE WHEN 3 + k % 14 >= 16 THEN CAST(c AS HUGEINT) * 1000000000 ELSE ((CAST(c AS HUGEINT) * 1000000000 + CAST(power(10, 16 - 3 - k % 14) AS HUGEINT) - 1) // CAST(power(10, 16 - 3 - k % 14) AS HUGEINT)) * CAST(power(10, 16 - 3 - k % 14) AS HUGEINT) END AS VARCHAR) rounded FROM bk")),
    "amounts_parsed": (amounts_parsed, sql(BOOK, "SELECT offer_id, CASE WHEN k % 2 = 0 THEN 'XRP' ELSE 'T' || (u % 7) END currency, CASE WHEN k % 2 = 0 THEN CAST(c * 10 AS VARCHAR) ELSE rpad(CAST(c AS VARCHAR), 16, '0') END units, CASE WHEN k % 2 = 0 THEN -6 ELSE length(CAST(c AS VARCHAR)) - 16 END exponent, false inexact FROM bk")),
    "rel_error": (rel_error, f"WITH {COMPARED} SELECT l_orderkey, l_partkey, l_suppkey, {n('l_linenumber')} l_linenumber, {r('l_extendedprice')} l_extendedprice, {r(rel('model', 'rl'))} AS rel, {r(rel('model', 'rl', ''))} AS signed FROM cp"),
    "totals_error": (totals_error, f"WITH {COMPARED}, t AS (SELECT l_orderkey, CAST(sum(CAST(model AS DECIMAL(18,2))) AS DOUBLE) a, CAST(sum(CAST(rl AS DECIMAL(18,2))) AS DOUBLE) b, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) x FROM cp GROUP BY 1), u AS (SELECT *, x + l_orderkey % 3 y FROM t), v AS (SELECT *, {rel('a', 'b')} e1, {rel('x', 'y')} e2, {rel('x', 'y', '')} e3 FROM u) "
        f"SELECT l_orderkey, {r('e1')} in_rel_err, {r('e2')} out_rel_err, {r('CASE WHEN e1 IS NULL THEN e2 ELSE greatest(e1, e2) END')} max_rel_err, {r('e3')} out_signed_rel_err FROM v"),
    "error_hist": (error_hist, f"WITH {ERRS} SELECT l_returnflag, bucket, n, {n('rk')} bucket_rank FROM hr"),
    "cumulative_hist": (cumulative_hist, f"WITH {ERRS}, s AS (SELECT l_returnflag, sum(n) t, sum(CASE WHEN rk = 0 THEN n ELSE 0 END) a, sum(CASE WHEN rk <= 4 THEN n ELSE 0 END) b, sum(CASE WHEN rk <= 5 THEN n ELSE 0 END) c, sum(CASE WHEN rk = 6 THEN n ELSE 0 END) d FROM hr GROUP BY 1) "
        + " UNION ALL ".join(f"SELECT l_returnflag, '{lab}' AS label, {n(col)} n, {r(f'CAST({col} AS DOUBLE) / t')} AS share FROM s" for lab, col in (("=0", "a"), ("<= 1e-12", "b"), ("<= 1e-9", "c"), ("> 1e-9", "d")))),
    "moments": (moments, f"WITH q AS (SELECT l_suppkey, nullif(l_discount, 0) v FROM lineitem) SELECT l_suppkey, count(v) n, {r('avg(v)', 5)} mean, {r('CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0) END', 5)} AS stddev FROM q GROUP BY 1"),
    "t_stat": (t_stat, f"WITH q AS (SELECT l_returnflag, l_discount - 0.05::DOUBLE g FROM lineitem), s AS (SELECT l_returnflag, count(*) n, avg(g) a, stddev_samp(g) d FROM q GROUP BY 1) SELECT l_returnflag, n, n - 1 df, {r('a', 4)} mean, {r('d', 4)} AS stddev, {r('a / (d / sqrt(n))', 4)} t_stat FROM s"),
    "t_test_p": (t_test_p, "WITH RECURSIVE q AS (SELECT l_suppkey, l_discount - 0.05::DOUBLE g FROM lineitem), s AS (SELECT l_suppkey, count(*) n, avg(g) a, stddev_samp(g) d FROM q GROUP BY 1), "
        f"{student_t_sql('s', 'l_suppkey')} SELECT l_suppkey, n, v df, {r('a', 6)} mean, {r('d', 6)} AS stddev, {r('t', 6)} t_stat, {r('p', 6)} p_value, p < 0.05 reject FROM tq"),
    "pct_nearest": (pct_nearest, "SELECT l_suppkey, count(*) n_values, " + ", ".join(f"{r(f'quantile_disc(l_extendedprice, {p / 100})')} p{p}" for p in (5, 50, 90, 95, 99)) + " FROM lineitem GROUP BY 1"),
    "pct_linear": (pct_linear, "SELECT p_brand, count(*) n_values, " + ", ".join(f"{r(f'quantile_cont(p_retailprice, {q})', 4)} {name}" for name, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))) + " FROM part GROUP BY 1"),
    "pct_ceil": (pct_ceil, "WITH q AS (SELECT p_brand, p_retailprice v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) rk, count(*) OVER (PARTITION BY p_brand) m FROM part) SELECT p_brand, max(m) n_values, " + ", ".join(f"{r(f'max(CASE WHEN rk = ceil((m - 1) * {q}) + 1 THEN v END)')} {name}" for name, q in (("c50", "0.5"), ("c95", "0.95"), ("c99", "0.99"))) + " FROM q GROUP BY 1"),
    "topk": (topk, f"WITH q AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) rk FROM part) SELECT p_brand, p_partkey, {r('p_retailprice')} p_retailprice, rk AS rank FROM q WHERE rk <= 3"),
    "amount_only": (amount_only, "WITH q AS (SELECT o_orderpriority pair, CAST(o_orderkey AS VARCHAR) tx, round(o_totalprice % 1000, 2) e FROM orders), x AS (SELECT pair, count(*) av, count(*) + CASE WHEN pair = '5-LOW' THEN 10 ELSE -7 END ex FROM q GROUP BY 1), "
        f"w AS (SELECT q.*, av, ex, row_number() OVER (PARTITION BY q.pair ORDER BY e, tx) rk FROM q JOIN x USING (pair)) SELECT pair, ex expected_count, av available, av >= ex complete, {r('min(e)', 4)} min_err, {r('quantile_cont(e, 0.5)', 4)} median_err, {r('max(e)', 4)} max_err FROM w WHERE rk <= least(av, ex) GROUP BY 1, 2, 3, 4"),
}
