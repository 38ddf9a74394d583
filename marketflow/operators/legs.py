"""Realised trade legs from metadata and their comparison with model legs.

All nodes of a transaction come from one metadata record and all its model legs from one quote, so
groups keyed by transaction are bounded by a record and use plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions import amounts as A
from marketflow.functions import labels as L
from marketflow.functions import stats as S
from marketflow.functions.constants import NATIVE

UNITS = "decimal(38,0)"


def _ordered(before: str, after: str, change: str) -> tuple[str, str]:
    """The larger and the smaller balance of a change."""
    return (after, before) if change == "increase" else (before, after)


def _transition(before: str, after: str, change: str, source: str, gap: str) -> str:
    """SQL of a leg side: the taken amount ``gap`` with the balance before and after it."""
    end = lambda x: f"named_struct('units', {x}.units, 'exponent', {x}.exponent)"
    return (
        f"named_struct('units', {gap}.units, 'exponent', {gap}.exponent, 'pre', {end(before)}, 'post', {end(after)}, "
        f"'state_change', '{change}', 'state_source', '{source}')"
    )


def _with_sides(df: DataFrame, sides: dict[str, tuple[str, str, str, str, str]]) -> DataFrame:
    """Add leg sides from (before, after, change, source, native): the amounts between two balances, all of a row together."""
    gaps = {f"{out}_gap": (*_ordered(before, after, change), -1, native) for out, (before, after, change, _, native) in sides.items()}
    made = {out: _transition(before, after, change, source, f"{out}_gap") for out, (before, after, change, source, _) in sides.items()}
    return A.computed(A.summed(df, gaps), made).drop(*gaps)


NODES = "result.meta.AffectedNodes"


def _body(node: Column) -> Column:
    return F.coalesce(node["CreatedNode"], node["ModifiedNode"], node["DeletedNode"])


def _read(body: Column, field: str, images: tuple[str, ...]) -> Column:
    return F.coalesce(*[body[image][field] for image in images])


BEFORE, AFTER = ("PreviousFields", "FinalFields", "NewFields"), ("FinalFields", "NewFields")


def _line_texts(nodes: Column) -> Column:
    """Trust lines of one record, in its order: currency, both accounts, the balances' raw texts. A record lists a line once."""

    def line(node: Column) -> Column:
        body = _body(node)
        low, high = (_read(body, limit, BEFORE) for limit in ("LowLimit", "HighLimit"))
        before = _read(body, "Balance", BEFORE)
        return F.struct(
            F.coalesce(A.currency_of(before), A.currency_of(low), A.currency_of(high)).alias("currency"),
            A.issuer_of(low).alias("low"), A.issuer_of(high).alias("high"),
            before.alias("before"), F.coalesce(_read(body, "Balance", AFTER), before).alias("after"),
        )

    return F.transform(F.filter(nodes, lambda n: _body(n)["LedgerEntryType"] == "RippleState"), line)


def _held_with(line: Column, account: Column, currency: Column, other: Column) -> Column:
    ends = ((line["low"] == account) & (line["high"] == other)) | ((line["high"] == account) & (line["low"] == other))
    return (line["currency"] == currency) & ends


def _touched_offers(nodes: Column) -> Column:
    """Modified and deleted offers of one record with both images: owner, assets and the amounts' raw texts."""

    def touched(node: Column) -> Column:
        body = F.coalesce(node["ModifiedNode"], node["DeletedNode"])
        return (body["LedgerEntryType"] == "Offer") & node["CreatedNode"].isNull() & body["FinalFields"].isNotNull() & body["PreviousFields"].isNotNull()

    def offer(node: Column) -> Column:
        body = F.coalesce(node["ModifiedNode"], node["DeletedNode"])
        gets, pays = _read(body, "TakerGets", BEFORE), _read(body, "TakerPays", BEFORE)
        return F.struct(
            F.when(node["ModifiedNode"].isNull(), "deleted").otherwise("modified").alias("kind"),
            body["LedgerIndex"].alias("source_id"), body["FinalFields"]["Account"].alias("owner"),
            A.currency_of(gets).alias("out_currency"), A.issuer_of(gets).alias("out_issuer"),
            A.currency_of(pays).alias("in_currency"), A.issuer_of(pays).alias("in_issuer"),
            gets.alias("gp"), pays.alias("pp"), body["FinalFields"]["TakerGets"].alias("gf"), body["FinalFields"]["TakerPays"].alias("pf"),
        )

    return F.transform(F.filter(nodes, touched), offer)


def _beside(found: DataFrame, intents: DataFrame | None, names: list[str]) -> DataFrame:
    """Rows taken from records with columns of their intents, which are joined unless the rows have them."""
    return found if intents is None else found.join(intents.select("tx_hash", *names), "tx_hash")


def _taken(meta: DataFrame, intents: DataFrame | None, names: list[str], **fields: Column) -> DataFrame:
    """Fields of records under their names, and the columns of intents where the records carry them."""
    return meta.select("tx_hash", *(names if intents is None else []), *[c.alias(n) for n, c in fields.items()])


def real_offer_legs(meta: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Book legs: what each touched offer in the intent's direction gave and took.

    A deleted offer with one side at zero counts the other side as zero. When the owner has exactly
    one such offer on an issued asset and their trust line moved the right way, the trust line's
    movement is the leg, because it includes effects the offer fields do not show.

    Offers, their owners' lines and the number of an owner's claims come from one record and are found inside its row; only
    the lines of an owner are read. The one exchange is the join with the intents, on texts taken from the record; there is none
    without ``intents``: then ``meta`` is :func:`intent_records`, where a record's intent stands beside it.
    """
    names = ["in_currency", "out_currency"]
    nodes = _taken(meta, intents, names, nodes=F.col(NODES))
    found = A.computed(nodes, {"offers": _touched_offers(F.col("nodes"))}).filter("size(offers) > 0")
    mine = F.filter("offers", lambda o: (o["out_currency"] == F.col("out_currency")) & (o["in_currency"] == F.col("in_currency")))
    if intents is None:
        found = found.withColumn("offers", mine).filter("size(offers) > 0")
    rows = _beside(A.computed(found, {"lines": _line_texts(F.col("nodes"))}).drop("nodes"), intents, names)
    if intents is not None:
        rows = rows.withColumn("offers", mine).filter("size(offers) > 0")

    def claims(offer: Column, side: str) -> Column:
        """Counted before the amounts are read: every offer of the owner claims the same trust line."""
        names = ("owner", f"{side}_currency", f"{side}_issuer")
        same = lambda other: other[names[0]].eqNullSafe(offer[names[0]]) & other[names[1]].eqNullSafe(offer[names[1]]) & other[names[2]].eqNullSafe(offer[names[2]])
        return F.size(F.filter("offers", same))

    def line(offer: Column, side: str) -> Column:
        held = F.filter("lines", lambda x: F.coalesce(_held_with(x, offer["owner"], offer[f"{side}_currency"], offer[f"{side}_issuer"]), F.lit(False)))
        return F.try_element_at(held, F.lit(-1))

    # The innermost lambdas come first: claims and lines are bound to each offer beside it.
    paired = F.transform("offers", lambda o: F.struct(
        o.alias("o"), *[claims(o, s).alias(f"n_{s}") for s in ("out", "in")], *[line(o, s).alias(f"l_{s}") for s in ("out", "in")]))
    each = rows.select("tx_hash", F.inline(paired))
    raw = each.select(
        "tx_hash", "o.kind", "o.source_id", "o.owner", "n_out", "n_in", *[F.col(f"o.{c}").alias(f"_{c}") for c in ("gp", "pp", "gf", "pf")],
        *[F.col(f"l_{s}.{image}").alias(f"_{s}_{image}") for s in ("out", "in") for image in ("before", "after")],
        *[F.when(F.col(f"l_{s}.low") == F.col("o.owner"), 1).otherwise(-1).alias(f"_{s}_sign") for s in ("out", "in")],
    )
    amounts = ("_gp", "_pp", "_gf", "_pf")
    parsed = A.parsed(raw, {f"{name}a": name for name in amounts})
    zeroed = lambda own, other: (
        f"named_struct('units', if(kind = 'deleted' and {own}.units > 0 and {other}.units <= 0, "
        f"cast(0 as {UNITS}), {own}.units), 'exponent', {own}.exponent)"
    )
    closed = A.computed(parsed, {"_go": zeroed("_gfa", "_pfa"), "_po": zeroed("_pfa", "_gfa")})
    native = {"out": f"_gpa.currency = '{NATIVE}'", "in": f"_ppa.currency = '{NATIVE}'"}
    taken = {
        "_offer_out": ("_gpa", "_go", "decrease", "offer_node", native["out"]),
        "_offer_in": ("_ppa", "_po", "decrease", "offer_node", native["in"]),
    }
    by_offer = _with_sides(closed, taken).filter("_offer_out.units > 0 and _offer_in.units > 0")
    # A line is read only where it may be the leg.
    kinds = {"out": "decrease", "in": "increase"}
    wanted = lambda s: f"n_{s} = 1 and _{s}_before is not null and _{s}_after is not null"
    by_offer = A.parsed(by_offer, {f"_{s}_{i}_a": f"if({wanted(s)}, _{s}_{i}, null)" for s in kinds for i in ("before", "after")})
    end = lambda x, s: f"if({x} is null, null, named_struct('units', cast({x}.units * _{s}_sign as {UNITS}), 'exponent', {x}.exponent))"
    by_offer = A.computed(by_offer, {f"_{s}_{i}_e": end(f"_{s}_{i}_a", s) for s in kinds for i in ("before", "after")})
    by_offer = _with_sides(by_offer, {f"_line_{s}": (f"_{s}_before_e", f"_{s}_after_e", change, "account_delta", "false") for s, change in kinds.items()})
    pick = lambda s: F.expr(f"if(coalesce(_line_{s}.units > 0, false), _line_{s}, _offer_{s})").alias(s)
    return by_offer.select("tx_hash", F.lit("CLOB").alias("src"), "source_id", "owner", pick("out"), pick("in"))


def _pool_lines(df: DataFrame, account: str, out: str = "held") -> DataFrame:
    """Add ``out``: the lines of the pool ``account`` in record order, their balances read and signed from the pool's end."""
    mine = F.filter("lines", lambda x: F.coalesce((x["low"] == F.col(account)) | (x["high"] == F.col(account)), F.lit(False)))
    picked = df.withColumn("_mine", mine)
    low = f"if(li.low = {account}, 1, -1)"
    turned = lambda parsed: A._let(parsed, "b", (
        f"if(b is null, null, named_struct('units', cast(b.units * {low} as {UNITS}), 'exponent', b.exponent, 'value', b.value * {low}))"))
    ends = f"'before', {turned(A.parse_sql('li.before'))}, 'after', {turned(A.parse_sql('li.after'))}"
    states = f"transform(_mine, li -> named_struct('currency', li.currency, 'low', li.low, 'high', li.high, {ends}))"
    return A.computed(picked, {out: states}).drop("_mine")


def _pool_roots(nodes: Column) -> Column:
    """Account roots of one record in its order, with their native balances and whether they belong to a pool."""

    def root(node: Column) -> Column:
        body = _body(node)
        raw = lambda c: F.struct(A.drops_of(c).cast(UNITS).alias("units"), F.lit(-6).alias("exponent"))
        account = F.coalesce(_read(body, "Account", AFTER), _read(body, "Account", BEFORE))
        return F.struct(
            account.alias("account"), _read(body, "AMMID", BEFORE).isNotNull().alias("pool"),
            raw(_read(body, "Balance", BEFORE)).alias("native_pre"), raw(_read(body, "Balance", AFTER)).alias("native_post"),
        )

    roots = F.transform(F.filter(nodes, lambda n: _body(n)["LedgerEntryType"] == "AccountRoot"), root)
    return F.filter(roots, lambda r: r["account"].isNotNull() & r["native_pre"]["units"].isNotNull())


def real_pool_legs(meta: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Pool leg: balance movements of the first pool account and its first two-sided trust line, found inside the record's row.

    Without ``intents``, ``meta`` is :func:`intent_records` and nothing is joined.
    """
    names = ["in_currency", "out_currency"]
    across = (F.col("in_currency") == NATIVE) != (F.col("out_currency") == NATIVE)
    pools = F.filter(_pool_roots(F.col("nodes")), lambda r: r["pool"] & r["native_post"]["units"].isNotNull())
    nodes = _taken(meta if intents is not None else meta.filter(across), intents, names, nodes=F.col(NODES))
    pooled = A.computed(nodes, {"p": F.get(pools, F.lit(0))}).filter("p is not null and p.native_pre.units <> p.native_post.units")
    found = A.computed(pooled, {"lines": _line_texts(F.col("nodes"))}).drop("nodes")
    joined = _beside(found, intents if intents is None else intents.filter(across), names)
    moving = joined.select("*", F.col("p.account").alias("pool_account"), "p.native_pre", "p.native_post")
    held = F.filter("held", lambda x: F.coalesce((x["before"]["units"] > 0) & (x["after"]["units"] > 0), F.lit(False)))
    line = _pool_lines(moving, "pool_account").withColumn("l", F.get(held, F.lit(0))).filter("l is not null").select("*", "l.before", "l.after")
    moved = line.filter(f"not ({A.same_amount_sql('before', 'after')})")
    line, native = ("before", "after"), ("native_pre", "native_post")
    made = _with_sides(moved, {
        "_line_out": (*line, "decrease", "pool_line", "false"), "_line_in": (*line, "increase", "pool_line", "false"),
        "_native_out": (*native, "decrease", "pool_account", "true"), "_native_in": (*native, "increase", "pool_account", "true"),
    })
    first = F.col("in_currency") == NATIVE
    pick = lambda then, other: F.when(first, F.col(then)).otherwise(F.col(other))
    return made.select(
        "tx_hash", F.lit("AMM").alias("src"), F.col("pool_account").alias("source_id"), F.col("pool_account").alias("owner"),
        pick("_line_out", "_native_out").alias("out"), pick("_native_in", "_line_in").alias("in"),
    )


def real_legs(meta: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    return real_offer_legs(meta, intents).unionByName(real_pool_legs(meta, intents))


def pool_pre_state(meta: DataFrame, swaps: DataFrame) -> DataFrame:
    """Exact pool reserves before each swap: the named account first, else the first candidate, found inside the record's row.

    ``swaps`` names (tx_hash, amm_account, token_currency, token_issuer).
    """
    expected = swaps.select("tx_hash", "amm_account", "token_currency", F.coalesce("token_issuer", F.lit("")).alias("token_issuer"))
    found = meta.select("tx_hash", _pool_roots(F.col(NODES)).alias("roots"), _line_texts(F.col(NODES)).alias("lines")).join(expected, "tx_hash")
    named = F.get(F.filter("roots", lambda r: r["account"] == F.col("amm_account")), F.lit(0))
    pool = F.coalesce(named, F.get(F.filter("roots", lambda r: r["pool"]), F.lit(0)))
    rows = found.withColumn("p", pool).filter("p is not null").withColumn("pool_account", F.col("p.account"))
    issuer_ok = lambda x: (F.col("token_issuer") == "") | (F.col("token_issuer") == x["low"]) | (F.col("token_issuer") == x["high"])
    rows = rows.withColumn("lines", F.filter("lines", lambda x: F.coalesce((x["currency"] == F.col("token_currency")) & issuer_ok(x), F.lit(False))))
    held = F.filter("held", lambda x: F.coalesce(x["before"]["units"] > 0, F.lit(False)))
    reserve = _pool_lines(rows, "pool_account").withColumn("token_reserve", F.get(held, F.lit(0))["before"]).filter("token_reserve is not null")
    return reserve.select(
        "tx_hash", "pool_account", F.col("p.native_pre.units").cast("bigint").alias("native_reserve"),
        F.col("token_reserve.units").alias("token_units"), F.col("token_reserve.exponent").alias("token_exponent"),
        F.col("token_reserve.value").alias("token_reserve"),
    )


def source_funds(meta: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """What the sender could spend: (tx_hash, source_funds, source_limited, source_units, source_exponent); no row without a balance.

    Native funds leave out reserve and fee, and a used ticket frees one reserve unit. A line without a positive balance gives
    NULL funds. ``source_units`` and ``source_exponent`` are exact and decide ``source_limited``; ``source_funds`` is NULL where
    the balance is too large for DECIMAL(38,18). The sender's balances are found inside the record's row. Without ``intents``,
    ``meta`` is :func:`intent_records` and nothing is joined.
    """
    nodes = F.col(NODES)
    account = F.col("result.Account")
    names = ["in_currency", "in_issuer", "in_amount"]

    def root(node: Column) -> Column:
        body = _body(node)
        return F.struct(A.drops_of(_read(body, "Balance", BEFORE)).alias("balance"), F.coalesce(_read(body, "OwnerCount", BEFORE), F.lit(0)).alias("owners"))

    own = F.filter(nodes, lambda n: (_body(n)["LedgerEntryType"] == "AccountRoot") & (_read(_body(n), "Account", BEFORE) == account))
    held = F.filter(_line_texts(nodes), lambda x: (x["low"] == account) | (x["high"] == account))
    found = _beside(_taken(
        meta, intents, names, account=account, fee=F.coalesce(F.col("result.Fee").try_cast("bigint"), F.lit(0)),
        ticket=F.col("result.TicketSequence").isNotNull(),
        root=F.get(F.filter(F.transform(own, root), lambda r: r["balance"].isNotNull()), F.lit(0)),
        # Native funds read no line.
        lines=held if intents is not None else F.when(F.col("in_currency") != NATIVE, held),
    ), intents, names)
    native = F.col("in_currency") == NATIVE
    # An issuer may send its own asset: then any of its lines in that currency counts.
    issuer = lambda x: (x["low"] == F.col("in_issuer")) | (x["high"] == F.col("in_issuer"))
    mine = F.filter("lines", lambda x: F.coalesce((x["currency"] == F.col("in_currency")) & issuer(x) & x["before"].isNotNull(), F.lit(False)))
    line = F.when(~native & F.col("in_issuer").isNotNull(), F.get(mine, F.lit(0)))
    picked = found.withColumn("_line", line).withColumns({"_text": F.col("_line.before"), "_sign": F.when(F.col("_line.low") == F.col("account"), 1).otherwise(-1)})
    read = A.parsed(picked, {"_held": "_text"}).filter(F.when(native, F.col("root").isNotNull()).otherwise(F.col("_held").isNotNull()))
    owners = F.when(F.col("ticket"), F.greatest(F.col("root.owners") - 1, F.lit(0))).otherwise(F.col("root.owners"))
    drops = A.spendable_drops(F.col("root.balance"), owners) - F.col("fee")
    units = F.when(native, drops.cast(UNITS)).otherwise((F.col("_held.units") * F.col("_sign")).cast(UNITS))
    value = F.when(native, (drops.cast("decimal(38,18)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,18)")).otherwise(
        (F.col("_held.value") * F.col("_sign")).cast("decimal(38,18)"))
    exact = read.withColumns({"_units": units, "_exponent": F.when(native, F.lit(-6)).otherwise(F.col("_held.exponent")), "_value": value})
    exact = exact.withColumn("_funds", F.when(F.col("_units") > 0, F.struct(F.col("_units").alias("units"), F.col("_exponent").alias("exponent"))))
    gap = A.summed(exact, {"_gap": ("_funds", "in_amount", -1, "false")})
    return gap.select(
        "tx_hash", F.when(F.col("_funds").isNotNull(), F.col("_value")).alias("source_funds"), (F.col("_gap.units") < 0).alias("source_limited"),
        F.col("_funds.units").alias("source_units"), F.col("_funds.exponent").alias("source_exponent"),
    )


def _leg_id(src: Column, source_id: Column) -> Column:
    """Book legs are identified by their offer, pool legs all together."""
    return F.when(src == "CLOB", source_id).otherwise(F.lit("AMM"))


def _legs_of(legs: DataFrame, columns: list[Column], leg, out: str) -> DataFrame:
    """One row per transaction with its legs in order. Only the columns are shuffled: what orders a leg repeats them, and is made after."""
    gathered = legs.select("tx_hash", F.struct(*columns).alias("_l")).groupBy("tx_hash").agg(F.collect_list("_l").alias("_legs"))
    return gathered.select("tx_hash", F.sort_array(F.transform("_legs", leg)).alias(out))


def _model_arrays(model: DataFrame) -> DataFrame:
    """One row per transaction with ``_model``, its model legs ordered by identity, amounts and number."""
    paid = "owner_out" in model.columns

    def leg(x: Column) -> Column:
        amounts = [x[c][part].alias(f"{c}_{part}") for c in ("out", "in") for part in ("units", "exponent")]
        owner_out = F.coalesce(x["owner_out"], x["out"]) if paid else x["out"]
        return F.struct(
            F.struct(x["src"].alias("src"), _leg_id(x["src"], x["source_id"]).alias("leg_id")).alias("id"),
            F.struct(*amounts, x["leg_no"].alias("leg_no")).alias("place"),
            F.struct(*[x[c].alias(c) for c in ("leg_no", "out", "in")], owner_out.alias("owner_out")).alias("leg"),
        )

    return _legs_of(model, [F.col(c) for c in ("src", "source_id", "leg_no", "out", "in", *(["owner_out"] if paid else []))], leg, "_model")


def _real_arrays(real: DataFrame) -> DataFrame:
    """One row per transaction with ``_real``, its real legs ordered by identity and balances (output before input)."""
    kept = [c for c in real.columns if c not in ("tx_hash", "src")]

    def leg(x: Column) -> Column:
        ends = [x[c][end][part].alias(f"{c}_{end}_{part}") for c in ("out", "in") for end in ("pre", "post") for part in ("units", "exponent")]
        kinds = {c: x[c]["state_change"].alias(f"{c}_change") for c in ("out", "in")}
        return F.struct(
            F.struct(x["src"].alias("src"), _leg_id(x["src"], x["source_id"]).alias("leg_id")).alias("id"),
            F.struct(kinds["out"], *ends[:4], kinds["in"], *ends[4:]).alias("place"), F.struct(*[x[c].alias(c) for c in kept]).alias("leg"),
        )

    return _legs_of(real, [F.col(c) for c in ("src", *kept)], leg, "_real")


def _groups() -> Column:
    """Legs of both arrays by identity: (id, model, real), each side in its order. NULL identities equal each other."""
    of = lambda side: F.transform(side, lambda x: x["id"])
    same = lambda side, k: F.filter(side, lambda x: x["id"].eqNullSafe(k))
    ids = F.array_distinct(F.concat(of("_model"), of("_real")))
    return F.transform(ids, lambda k: F.struct(k.alias("id"), same("_model", k).alias("model"), same("_real", k).alias("real")))


def _filled(joined: DataFrame) -> DataFrame:
    """A side without a row has no legs; ``_groups`` is made once for all that reads it."""
    sides = {name: F.coalesce(name, F.array()) for name in ("_model", "_real")}
    return joined.withColumns(sides).withColumn("_groups", _groups())


def _structure() -> dict[str, Column]:
    size = lambda side: F.size(side).cast("bigint")
    all_of = lambda test: F.forall("_groups", lambda g: test(F.size(g["model"]), F.size(g["real"])))
    some = lambda side, pool: F.exists(side, lambda x: (x["id"]["src"] == "AMM") == F.lit(pool))
    return {
        "model_leg_count": size("_model"),
        "real_leg_count": size("_real"),
        "structure_match": all_of(lambda model, real: model == real),
        "identity_match": all_of(lambda model, real: (model > 0) & (real > 0)),
        "pairable": all_of(lambda model, real: (real == 1) | (model == real)),
        "model_pool": some("_model", True),
        "model_book": some("_model", False),
        "real_pool": some("_real", True),
        "real_book": some("_real", False),
    }


def structure_match(model: DataFrame, real: DataFrame) -> DataFrame:
    """Per transaction: leg counts, whether both sides hold the same legs, and whether they pair up.

    Each side shuffles once into an array per transaction; the multisets are compared inside the row.
    """
    both = _filled(_model_arrays(model).join(_real_arrays(real), "tx_hash", "full"))
    return both.select("tx_hash", *[test.alias(name) for name, test in _structure().items()])


def _pairs(real_columns: list[str]) -> Column:
    """Real legs of ``_groups`` with the model legs they face, as :func:`pair_legs` states."""

    def of(group: Column) -> Column:
        n_model, n_real = F.size(group["model"]), F.size(group["real"])

        def faced(leg: Column, at: Column) -> Column:
            whole = F.sort_array(F.transform(group["model"], lambda x: x["leg"]))
            met = F.when((n_real == 1) & (n_model > 0), whole).when((n_real > 1) & (n_real == n_model), F.array(F.get(group["model"], at)["leg"]))
            own = [leg["leg"][c].alias(c) for c in real_columns]
            return F.struct(
                group["id"]["src"].alias("src"), group["id"]["leg_id"].alias("leg_id"), (at + 1).alias("leg_rank"),
                *own, n_real.cast("bigint").alias("n_real"), met.alias("model_legs"),
            )

        return F.transform(group["real"], faced)

    return F.flatten(F.transform("_groups", of))


def pair_legs(model: DataFrame, real: DataFrame) -> DataFrame:
    """Real legs with the model legs they face.

    A single real leg takes all model legs of its identity; equal numbers pair by rank; other sizes
    stay unpaired (NULL). ``model_legs`` holds the faced legs in model order. A model leg may have ``owner_out``,
    what the owner pays with the transfer fee on top of ``out``; it equals ``out`` where absent. Further columns of
    ``real`` are kept; they order ties, so maps are not allowed among them.
    """
    kept = [c for c in real.columns if c not in ("tx_hash", "src")]
    both = _filled(_real_arrays(real).join(_model_arrays(model), "tx_hash", "left"))
    return both.select("tx_hash", F.inline(_pairs(kept)))


def _project(side: str) -> str:
    """SQL of the balance of pair ``p`` after the faced model amounts, applied one by one with ledger rounding.

    An account balance falls by what its owner paid, an offer's amount by what it gave.
    """
    taken = "if(p.`out`.state_source = 'account_delta', v.owner_out, v.`out`)" if side == "out" else "v.`in`"
    pre = f"p.`{side}`.pre"
    start = f"named_struct('units', cast({pre}.units as {UNITS}), 'exponent', cast({pre}.exponent as int))"
    turn = f"named_struct('units', cast({taken}.units * if(p.`{side}`.state_change = 'increase', 1, -1) as {UNITS}), 'exponent', {taken}.exponent)"
    native = f"{side}_currency = '{NATIVE}'"
    step = A._let(turn, "f", A.signed_sum_sql("u", "f", 1, native))
    return f"aggregate(p.model_legs, {start}, (u, v) -> {step})"


def _tested(df: DataFrame) -> DataFrame:
    """Add ``_tested``: per pair its place, whether each side ends at the real balance, and the residuals."""
    held = "'src', p.src, 'leg_id', p.leg_id, 'leg_rank', p.leg_rank"
    ends = ", ".join(f"'{s}_post', p.`{s}`.post, '{s}_projected', {_project(s)}" for s in ("out", "in"))
    gap = lambda s: A.signed_sum_sql(f"p.{s}_projected", f"p.{s}_post", -1, "false")
    same = lambda s: f"coalesce({A.same_amount_sql(f'p.{s}_projected', f'p.{s}_post')}, false)"
    tests = ", ".join(f"'{s}_ok', {same(s)}, '{s}_gap', {gap(s)}" for s in ("out", "in"))
    projected = df.withColumn("_projected", F.expr(f"transform(_pairs, p -> named_struct({held}, {ends}))"))
    return projected.withColumn("_tested", F.expr(f"transform(_projected, p -> named_struct({held}, {tests}))"))


def leg_totals(legs: DataFrame, *sides: str) -> DataFrame:
    """Summed sides per transaction as DOUBLE, in one pass; transactions without legs have no row."""
    value = lambda side: A.number_double(F.col(f"{side}.units"), F.col(f"{side}.exponent"))
    return legs.select("tx_hash", *[value(s).alias(s) for s in sides]).groupBy("tx_hash").agg(*[F.sum(s).alias(f"total_{s}") for s in sides])


def _summed(values: Column) -> Column:
    """Sum of an array of DOUBLE without its NULLs; 0 when empty."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def _with_totals(df: DataFrame) -> DataFrame:
    """Add model and real totals per side and their exact difference, formed at the smallest exponent of the transaction.

    Where 38 digits are not enough, the difference is that of DOUBLE totals.
    """
    out = df
    for side in ("in", "out"):
        signed = lambda legs, sign, s=side: F.transform(
            legs, lambda x: F.struct((x["leg"][s]["units"] * sign).cast(UNITS).alias("units"), x["leg"][s]["exponent"].cast("int").alias("exponent")))
        out = out.withColumn(f"_{side}", F.concat(signed("_model", 1), signed("_real", -1)))
        low = F.array_min(F.transform(F.filter(f"_{side}", lambda x: x["units"] != 0), lambda x: x["exponent"]))
        out = out.withColumn(f"_{side}_base", F.coalesce(low, F.lit(0)))
        exact = A.aligned_sql("x.units", "x.exponent", f"_{side}_base")
        add = f"aggregate(_{side}, cast(0 as {UNITS}), (total, x) -> cast(try_add(total, {exact}) as {UNITS}))"
        total = lambda legs, s=side: _summed(F.transform(legs, lambda x: A.number_double(x["leg"][s]["units"], x["leg"][s]["exponent"])))
        out = out.withColumns({f"_{side}_gap": F.expr(add), f"real_total_{side}": total("_real"), f"model_total_{side}": total("_model")})
        by_double = F.col(f"model_total_{side}") - F.col(f"real_total_{side}")
        out = out.withColumn(f"total_{side}_diff", F.coalesce(A.number_double(F.col(f"_{side}_gap"), F.col(f"_{side}_base")), by_double))
    return out


def compare_legs(targets: DataFrame, model: DataFrame, real: DataFrame) -> DataFrame:
    """Model against reality per target: matches, differences, endpoint residuals, first failing leg.

    ``targets`` has (tx_hash, in_currency, out_currency) and any columns to keep. ``model`` rows are
    (tx_hash, src, source_id, leg_no, out, in, optionally owner_out) with structs of (units, exponent); ``real`` comes from
    :func:`real_legs`.
    """
    # Three exchanges on tx_hash, one per input; all that follows happens inside the transaction's row.
    joined = _filled(targets.join(_model_arrays(model), "tx_hash", "left").join(_real_arrays(real), "tx_hash", "left"))
    paired = joined.withColumns({**_structure(), "_pairs": _pairs(["out", "in"])})
    joined = _with_totals(_tested(paired))
    place = lambda p, side, turn: F.struct(p["src"], p["leg_id"], p["leg_rank"], F.lit(turn).alias("turn"))
    fail = lambda p: F.least(F.when(~p["out_ok"], place(p, "out", 0)), F.when(~p["in_ok"], place(p, "in", 1)))
    residual = lambda s: _summed(F.transform("_tested", lambda p: A.number_double(p[f"{s}_gap"]["units"], p[f"{s}_gap"]["exponent"])))
    joined = joined.withColumns({
        "_in_ok": F.forall("_tested", lambda p: p["in_ok"]),
        "_out_ok": F.forall("_tested", lambda p: p["out_ok"]),
        **{f"_{s}_residual": residual(s) for s in ("in", "out")},
        "_fail": F.array_min(F.transform("_tested", fail)),
    })
    paired_up = F.col("identity_match") & F.col("pairable")
    structure = F.col("structure_match")
    side_ok = lambda s: paired_up & F.col(f"_{s}_ok")
    strict = side_ok("in") & side_ok("out")
    signed = lambda s: F.when(paired_up, S.residual_error(F.col(f"_{s}_residual"), F.col(f"real_total_{s}")))
    failed = paired_up & ~strict
    return joined.select(
        *targets.columns,
        "model_leg_count",
        "real_leg_count",
        strict.alias("strict_exact_match"),
        structure.alias("structure_match"),
        side_ok("in").alias("in_side_exact_match"),
        side_ok("out").alias("out_side_exact_match"),
        "total_in_diff",
        "total_out_diff",
        (F.col("total_in_diff") == 0).alias("total_in_match"),
        (F.col("total_out_diff") == 0).alias("total_out_match"),
        signed("in").alias("in_signed_err"),
        signed("out").alias("out_signed_err"),
        F.when(failed, F.col("_fail.src")).alias("first_failed_kind"),
        F.when(failed, F.col("_fail.leg_id")).alias("first_failed_id"),
        F.when(failed, F.when(F.col("_fail.turn") == 0, "out").otherwise("in")).alias("failed_side"),
        F.when(strict, "strict_exact_match").when(structure, "strict_failed_but_structure_matched")
        .otherwise("structure_mismatch").alias("fit_bucket"),
        L.path_shape(F.col("model_pool"), F.col("model_book")).alias("model_shape"),
        L.path_shape(F.col("real_pool"), F.col("real_book")).alias("real_shape"),
        L.leg_count_bucket(F.col("model_leg_count")).alias("model_legs_bucket"),
        L.leg_count_bucket(F.col("real_leg_count")).alias("real_legs_bucket"),
    )


def endpoint_residual(compared: DataFrame) -> DataFrame:
    """Signed, unsigned and largest endpoint error per transaction; NULL when legs do not pair up."""
    return compared.select(
        "tx_hash", "in_signed_err", "out_signed_err",
        F.abs("in_signed_err").alias("in_unsigned_err"), F.abs("out_signed_err").alias("out_unsigned_err"),
        F.greatest(F.abs("in_signed_err"), F.abs("out_signed_err")).alias("max_side_err"),
    )
