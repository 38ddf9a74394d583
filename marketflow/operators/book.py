"""Change logs and the state in force before a transaction.

A ledger's state restarts from the boundary snapshot of the ledger before it, so every scan is keyed
by ledger and the work splits over ledgers.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions import amounts as A
from marketflow.functions.constants import NATIVE
from marketflow.operators.scan import largest_group, next_row, prefix_last, prefix_sum, row_rank
from marketflow.session import max_group_rows

BEFORE_ALL = -1
VALUE = "decimal(38,18)"


def affected_nodes(meta: DataFrame, entry_type: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per affected node: ids, position, kind, body and the pre- and post-image fields, and columns to ``keep``."""
    nodes = meta.select(
        "tx_hash", "ledger_index", "transaction_index", *keep, F.posexplode("result.meta.AffectedNodes").alias("step", "n")
    )
    kind = (
        F.when(F.col("n.CreatedNode").isNotNull(), "created")
        .when(F.col("n.ModifiedNode").isNotNull(), "modified")
        .when(F.col("n.DeletedNode").isNotNull(), "deleted")
    )
    body = F.coalesce("n.CreatedNode", "n.ModifiedNode", "n.DeletedNode")
    out = nodes.select("tx_hash", "ledger_index", "transaction_index", *keep, "step", kind.alias("kind"), body.alias("body"))
    out = out.filter("kind is not null")
    return out if entry_type is None else out.filter(F.col("body.LedgerEntryType") == entry_type)


def pre(field: str) -> Column:
    """Value before the transaction: previous, else final, else new field."""
    return F.coalesce(f"body.PreviousFields.{field}", f"body.FinalFields.{field}", f"body.NewFields.{field}")


def post(field: str) -> Column:
    """Value after the transaction: final, else new field."""
    return F.coalesce(f"body.FinalFields.{field}", f"body.NewFields.{field}")


def side_of(gets: Column, pays: Column, asset: tuple[str, str] | None) -> Column:
    """Which asset a native <-> issued offer gives; NULL for other offers or another asset."""

    def issued(raw: Column) -> Column:
        ok = A.is_issued(raw)
        if asset is None:
            return ok
        return ok & (A.currency_of(raw) == asset[0]) & (A.issuer_of(raw) == asset[1])

    return F.when(~A.is_issued(gets) & issued(pays), "gets_native").when(
        issued(gets) & ~A.is_issued(pays), "gets_issued"
    )


def offer_changes(meta: DataFrame, asset: tuple[str, str] | None = None) -> DataFrame:
    """Change log of a book: per touched offer its state before and after, sides, kind and position."""
    nodes = affected_nodes(meta, "Offer").filter("body.LedgerIndex is not null")
    made, gone = F.col("kind") == "created", F.col("kind") == "deleted"

    def image(read, absent: Column) -> Column:
        state = F.struct(
            read("Account").alias("account"),
            read("Sequence").alias("sequence"),
            read("BookDirectory").alias("book_directory"),
            read("TakerGets").alias("taker_gets"),
            read("TakerPays").alias("taker_pays"),
        )
        whole = read("TakerGets").isNotNull() & read("TakerPays").isNotNull()
        return F.when(~absent & whole, state)

    rows = nodes.select(
        "tx_hash", "ledger_index", "transaction_index", "step", "kind",
        F.col("body.LedgerIndex").alias("offer_id"),
        image(pre, made).alias("before"),
        image(post, gone).alias("after"),
        F.col("body.PreviousFields.TakerGets").isNotNull().alias("gets_changed"),
        F.col("body.PreviousFields.TakerPays").isNotNull().alias("pays_changed"),
    )
    rows = rows.withColumns(
        {
            "side_pre": side_of(F.col("before.taker_gets"), F.col("before.taker_pays"), asset),
            "side_post": side_of(F.col("after.taker_gets"), F.col("after.taker_pays"), asset),
        }
    ).filter("side_pre is not null or side_post is not null")
    return rows.withColumn("action", F.when(F.col("side_post").isNotNull(), "upsert").otherwise("delete"))


def deleted_without_fill(meta: DataFrame) -> DataFrame:
    """Offers a transaction removed without changing their amounts."""
    nodes = affected_nodes(meta, "Offer").filter("kind = 'deleted' and body.LedgerIndex is not null")
    untouched = F.col("body.PreviousFields.TakerGets").isNull() & F.col("body.PreviousFields.TakerPays").isNull()
    return nodes.filter(untouched).select("tx_hash", F.col("body.LedgerIndex").alias("offer_id"))


def version_intervals(
    boundary: DataFrame, changes: DataFrame, group: list[str], entity: list[str], *, bounded: bool = False
) -> DataFrame:
    """Versions of each entity inside a group with the index range they are in force.

    ``boundary`` has group, entity, state; ``changes`` adds (transaction_index, step) and a NULL
    state for a delete. A version counts from just after its transaction up to and including the
    next change's index. Within a transaction the last step wins.
    """
    key = [*group, *entity]
    start = boundary.select(
        *key, F.lit(BEFORE_ALL).cast("bigint").alias("at"), F.lit(-1).alias("step"), "state"
    )
    log = changes.select(
        *key, F.col("transaction_index").cast("bigint").alias("at"), F.col("step").cast("int").alias("step"), "state"
    )
    rows = start.unionByName(log)
    following = next_row(rows, key, ["at", "step"], ["at"], "_next", bounded=bounded, gate=rows)
    ended = following.withColumn("until", F.col("_next.at")).drop("_next")
    live = F.col("state").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    return ended.filter(live).select(*key, F.col("at").alias("from_index"), F.col("until").alias("to_index"), "state")


def _targets_until(versions: DataFrame, marks: DataFrame, group: list[str], at: Column, out: str, bounded: bool) -> DataFrame:
    """Add ``out``: the number of marks of the group at or before ``at``, by one ordered scan of both."""
    rows = versions.withColumns({"_at": at, "_tag": F.lit(1), "_one": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    return prefix_sum(rows, group, ["_at", "_tag"], "_one", out, inclusive=True, bounded=bounded).filter("_tag = 1").drop("_at", "_tag", "_one")


def state_before(
    targets: DataFrame,
    versions: DataFrame,
    group: list[str],
    *,
    index: str = "transaction_index",
    span: int = 32,
    dense: bool = False,
) -> DataFrame:
    """Every entity version in force when each target runs: from < index <= to.

    The targets of a group are numbered in order and cut into slots of ``span``; a version stands in the slots of the targets
    between its ends, so both meet by equality on (group, slot). A version is copied once per ``span`` targets it is in force
    for and once more at most, however far apart the positions are; one without a target in its range goes. ``dense=True``
    states that positions number a group's rows, as those of a ledger do: then they are the slots' numbers themselves.
    """
    targets = targets.filter(F.col(index).isNotNull())
    placed = versions.filter("from_index is not null")
    until = F.coalesce(F.col("to_index").cast("bigint"), F.lit(2**63 - 1))
    if dense:
        reach = targets.groupBy(*group).agg(F.min(index).alias("_first"), F.max(index).alias("_final"))
        wanted = targets.withColumn("_number", F.col(index).cast("bigint"))
        ends = {"_low": F.greatest(F.col("from_index") + 1, F.col("_first")), "_high": F.least(until, F.col("_final"))}
        placed = placed.join(reach, group).withColumns(ends).drop("_first", "_final")
    else:
        marks = targets.select(*group, F.col(index).alias("_at"), F.lit(0).alias("_tag"), F.lit(1).alias("_one"))
        keys = marks.select(*group).unionByName(placed.select(*group))
        small = largest_group(keys, group)[1] <= max_group_rows(targets.sparkSession)
        wanted = row_rank(targets, group, [index], "_number", bounded=small)
        placed = _targets_until(placed, marks, group, F.col("from_index"), "_before", small).withColumn("_low", F.col("_before") + 1).drop("_before")
        placed = _targets_until(placed, marks, group, until, "_high", small)
    slot = lambda c: F.floor(c / span).cast("bigint")
    cut = placed.filter("_low <= _high").withColumn("_slot", F.explode(F.sequence(slot(F.col("_low")), slot(F.col("_high"))))).drop("_low", "_high")
    joined = wanted.withColumn("_slot", slot(F.col("_number"))).drop("_number").join(cut, [*group, "_slot"])
    inside = (F.col("from_index") < F.col(index)) & (F.col("to_index").isNull() | (F.col(index) <= F.col("to_index")))
    return joined.filter(inside).drop("_slot")


OFFER_STATE = ("account", "sequence", "book_directory", "taker_gets", "taker_pays")


FUNDING = ("owner_funds", "taker_gets_funded", "taker_pays_funded")
OFFER_VERSION = ("side", *OFFER_STATE, *FUNDING, "position")


def offer_versions(at_open: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions of each offer of a ledger with the index range they are in force, funding and place in the queue included.

    One pass over (ledger, offer) in order of change; the changes of one offer in one ledger are few, so groups are bounded.
    Funding published with a boundary offer holds until an amount changes or the offer goes. An offer keeps its place through
    changes; one that was deleted, or comes from the other side, queues anew. An offer stands on one side at a time; a change
    that takes it to an asset outside the book ends its version as a delete does.
    """
    key, order = ["ledger_index", "offer_id"], ["at", "step"]
    none = F.lit(None).cast("string")
    opening = at_open.select(
        *key, F.lit(BEFORE_ALL).cast("bigint").alias("at"), F.lit(-1).alias("step"), "side", F.struct(*OFFER_STATE).alias("image"),
        F.struct(*FUNDING).alias("funding"), F.col("position").cast("bigint").alias("place"),
    )
    # Offers placed inside the ledger queue behind the directory's earlier ones.
    late = F.lit(1_000_000_000) + F.col("transaction_index") * 10_000 + F.col("step")
    moves = changes.select(
        *key, F.col("transaction_index").cast("bigint").alias("at"), F.col("step").cast("int").alias("step"), F.col("side_post").alias("side"),
        F.col("after").alias("image"), F.struct(*[none.alias(c) for c in FUNDING]).alias("funding"), late.cast("bigint").alias("place"),
    )
    ordered = Window.partitionBy(*key).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    amounts = F.when(F.col("image").isNotNull(), F.struct("image.taker_gets", "image.taker_pays"))
    rows = opening.unionByName(moves).withColumn("_amounts", amounts)
    before = F.lag(F.struct("side", "_amounts")).over(ordered)
    rows = rows.withColumns({"_before": before, "until": F.lead("at").over(ordered)})
    fresh = (F.col("at") == BEFORE_ALL) | ~F.col("_amounts").eqNullSafe(F.col("_before._amounts"))
    begins = F.col("side").isNotNull() & ~F.col("side").eqNullSafe(F.col("_before.side"))
    held = lambda test, column: F.last(F.when(test, F.struct(F.col(column).alias("x"))), ignorenulls=True).over(so_far)["x"]
    rows = rows.withColumns({"funding": held(fresh, "funding"), "position": held(begins, "place")})
    live = F.col("side").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    return rows.filter(live).select(
        *key, F.col("at").alias("from_index"), F.col("until").alias("to_index"), "side", "image.*", "funding.*", "position"
    )


def book_before(targets: DataFrame, boundary: DataFrame, changes: DataFrame) -> DataFrame:
    """Order book each target met, one row per (transaction, side, offer).

    ``targets``: (tx_hash, ledger_index, transaction_index). ``boundary``: the snapshot of the ledger
    before, in long form with (ledger_index, side, offer_id, position, account, sequence,
    book_directory, taker_gets, taker_pays, owner_funds, taker_gets_funded, taker_pays_funded).
    ``changes``: :func:`offer_changes` of all transactions of those ledgers. The target's own
    pre-images replace the offers it touches in their place, or add them behind all others in the order of the record.
    """
    at_open = boundary.withColumn("ledger_index", F.col("ledger_index") + 1)
    ledgers = targets.select("ledger_index").distinct()
    at_open = at_open.join(ledgers, "ledger_index", "left_semi")
    versions = offer_versions(at_open, changes.join(ledgers, "ledger_index", "left_semi"))
    lived = state_before(targets, versions, ["ledger_index"], span=1024, dense=True).select(
        "tx_hash", "ledger_index", "transaction_index", "offer_id", *OFFER_VERSION
    )
    own = changes.filter("before is not null and side_pre is not null").select(
        "tx_hash", "ledger_index", "transaction_index", F.col("side_pre").alias("side"), "offer_id", "step",
        *[F.col(f"before.{c}").alias(f"_o_{c}") for c in OFFER_STATE],
    )
    own = own.join(targets.select("tx_hash").distinct(), "tx_hash", "left_semi")
    packed = F.struct(*[c for c in own.columns if c.startswith("_o_")])
    own = own.groupBy("tx_hash", "ledger_index", "transaction_index", "side", "offer_id").agg(
        F.max_by(packed, F.col("step")).alias("_own"), F.min("step").alias("_own_step")
    )
    joined = lived.join(own, ["tx_hash", "ledger_index", "transaction_index", "side", "offer_id"], "full")
    touched = F.col("_own").isNotNull()
    same = (F.col("_own._o_taker_gets") == F.col("taker_gets")) & (F.col("_own._o_taker_pays") == F.col("taker_pays"))
    keep_funding = ~touched | F.coalesce(same, F.lit(False))
    return joined.select(
        "tx_hash", "ledger_index", "transaction_index", "side", "offer_id",
        *[F.coalesce(F.col(f"_own._o_{c}"), F.col(c)).alias(c) for c in OFFER_STATE],
        *[F.when(keep_funding, F.col(c)).alias(c) for c in FUNDING],
        F.coalesce("position", (F.lit(2_000_000_000) + F.col("_own_step")).cast("bigint")).alias("position"),
        touched.alias("own_pre_image"),
        A.book_quality(F.coalesce(F.col("_own._o_book_directory"), F.col("book_directory"))).alias("quality"),
    )


def _line_fields() -> dict[str, Column]:
    """Of a trust-line node: the currency, both accounts and the balances' raw texts."""
    low, high, before = pre("LowLimit"), pre("HighLimit"), pre("Balance")
    currency = F.coalesce(A.currency_of(before), A.currency_of(low), A.currency_of(high))
    return {"currency": currency, "low": A.issuer_of(low), "high": A.issuer_of(high), "_pre": before, "_post": F.coalesce(post("Balance"), before)}


def trust_lines(nodes: DataFrame, images: tuple[str, ...] = ("before", "after"), of: str | None = None) -> DataFrame:
    """Trust-line nodes with both accounts, the currency and the signed balances of the low account.

    Reading an amount is costly: ``images`` names the balances wanted, ``of`` a column with the accounts whose lines are.
    """
    found = nodes.filter(F.col("body.LedgerEntryType") == "RippleState").select(
        "tx_hash", "ledger_index", "transaction_index", "step", "kind", *[c.alias(n) for n, c in _line_fields().items()], *([of] if of else [])
    ).filter("currency is not null and low is not null and high is not null")
    if of:
        found = found.filter(f"array_contains({of}, low) or array_contains({of}, high)").drop(of)
    texts = {"before": "_pre", "after": "_post"}
    return A.computed(found, {name: A.parse_sql(texts[name]) for name in images}).drop("_pre", "_post")


def funds_changes(meta: DataFrame) -> DataFrame:
    """Balance each transaction leaves behind: (account, currency, issuer, funds) per touched balance.

    Native funds are the balance less the reserve, floored at zero; a removed account leaves zero. A
    trust line sets the holder's side and zeroes the other. ``units`` and ``exponent`` are exact;
    ``funds`` is their DECIMAL(38,18) form, NULL (never zero) where the balance is too large for it. Accounts and lines are read
    in one pass over the nodes.
    """
    ids = ["tx_hash", "ledger_index", "transaction_index", "step"]
    names = ["account", "currency", "issuer", "funds", "units", "exponent"]
    entry, gone, root = F.col("body.LedgerEntryType"), F.col("kind") == "deleted", F.col("_root")
    left = F.greatest(A.spendable_drops(A.drops_of(post("Balance")), post("OwnerCount")), F.lit(0))
    of_root = {"_account": F.coalesce(post("Account"), pre("Account")), "_drops": F.when(gone, F.lit(0)).otherwise(left)}
    of_line = {name: c for name, c in _line_fields().items() if name != "_pre"}
    read = affected_nodes(meta).filter(entry.isin("AccountRoot", "RippleState")).select(
        *ids, gone.alias("_gone"), (entry == "AccountRoot").alias("_root"),
        *[F.when(entry == "AccountRoot", c).alias(n) for n, c in of_root.items()], *[F.when(entry == "RippleState", c).alias(n) for n, c in of_line.items()],
    )
    named = F.when(root, F.col("_account").isNotNull() & F.col("_drops").isNotNull()).otherwise(
        F.col("currency").isNotNull() & F.col("low").isNotNull() & F.col("high").isNotNull())
    parsed = A.computed(read.filter(named), {"after": f"if(_root, null, {A.parse_sql('_post')})"})
    zero, none = F.lit(0).cast(VALUE), F.lit(0).cast(A.UNITS)

    def left_with(account: str, currency: Column, issuer: Column, funds: Column, units: Column, exponent: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in zip(names, (F.col(account), currency, issuer, funds, units, exponent))])

    def end(account: str, issuer: str, sign: int) -> Column:
        held = (F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("after.units")).cast(A.UNITS) * sign).cast(A.UNITS)
        funds = F.when(held <= 0, zero).otherwise((F.col("after.value") * sign).cast(VALUE))
        return left_with(account, F.col("currency"), F.col(issuer), funds, F.greatest(held, none), F.coalesce(F.col("after.exponent"), F.lit(0)))

    drops = F.col("_drops")
    native = F.array(left_with("_account", F.lit(NATIVE), F.lit(""), drops.cast(VALUE), drops.cast(A.UNITS), F.lit(0)))
    known = parsed.filter(root | F.col("_gone") | F.col("after.units").isNotNull())
    return known.select(*ids, F.inline(F.when(root, native).otherwise(F.array(end("low", "high", 1), end("high", "low", -1)))))


# Balances a task may hold to sort out the changes nobody asks for.
MAX_ASKED = 100_000


def asked_changes(changes: DataFrame, requests: DataFrame) -> DataFrame:
    """Changes of the (account, currency, issuer) that requests name: what :func:`funds_before` reads of them.

    A record changes the balances of everybody it touches; the others would be shuffled for nothing. Up to ``MAX_ASKED`` balances
    (counted approximately) are sent to the tasks. Of more, nothing is left out: the changes go on as they are.
    """
    key = ["account", "currency", "issuer"]
    if requests.select(F.approx_count_distinct(F.struct(*key))).first()[0] > MAX_ASKED:
        return changes
    asked = requests.select(*[F.col(c).alias(f"_asked_{c}") for c in key]).distinct()
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_asked_{c}")) for c in key])
    return changes.join(F.broadcast(asked), same, "left_semi")


def funds_seeds(boundary: DataFrame, lines: DataFrame) -> DataFrame:
    """Opening funds per (ledger, account, asset): the smaller of what offers and lines publish.

    ``boundary`` has (ledger_index, account, currency, issuer, funds) from its offers, ``lines`` the
    same from account lines; both describe the ledger before. Where both also have ``units`` and ``exponent``, those
    decide, and stay.
    """
    names = ["ledger_index", "account", "currency", "issuer", "funds"]
    exact = all({"units", "exponent"} <= set(df.columns) for df in (boundary, lines))
    if not exact:
        rows = boundary.select(*names).unionByName(lines.select(*names)).filter("funds is not null")
        smallest = rows.groupBy(*names[:-1]).agg(F.min("funds").alias("funds"))
        return smallest.withColumn("ledger_index", F.col("ledger_index") + 1)
    names += ["units", "exponent"]
    rows = boundary.select(*names).unionByName(lines.select(*names)).filter("units is not null")
    # 16-digit units: by sign, then (exponent, units), which a negative sign turns round.
    sign = F.signum(F.col("units")).cast("int")
    order = F.struct(sign.alias("s"), F.when(sign == 0, 0).otherwise(F.col("exponent") * sign).alias("e"), F.col("units").alias("u"))
    smallest = rows.groupBy(*names[:4]).agg(F.min_by(F.struct("funds", "units", "exponent"), order).alias("_least"))
    return smallest.select((F.col("ledger_index") + 1).alias("ledger_index"), *names[1:4], "_least.*")


def funds_before(requests: DataFrame, seeds: DataFrame, changes: DataFrame) -> DataFrame:
    """Funds of (account, asset) before each requesting transaction; NULL when never seen.

    ``requests`` has (tx_hash, ledger_index, transaction_index, account, currency, issuer). Opening
    funds and earlier changes of the same ledger form one ordered stream per balance. ``units`` and
    ``exponent`` are the exact form, of an opening balance where the seeds have it.
    """
    key = ["ledger_index", "account", "currency", "issuer"]
    exact = {"units", "exponent"} <= set(seeds.columns)
    opened = (F.col("units"), F.col("exponent")) if exact else (F.lit(None), F.lit(None))
    opening = seeds.select(
        *key, F.lit(BEFORE_ALL).cast("bigint").alias("_at"), F.lit(1).alias("_tag"), F.lit(-1).alias("_step"),
        F.struct("funds", opened[0].cast(A.UNITS).alias("units"), opened[1].cast("int").alias("exponent")).alias("_state"),
    )
    later = changes.select(
        *key, F.col("transaction_index").alias("_at"), F.lit(1).alias("_tag"), F.col("step").alias("_step"),
        F.struct("funds", "units", "exponent").alias("_state"),
    )
    asked = requests.select(
        *key, F.col("transaction_index").alias("_at"), F.lit(0).alias("_tag"), F.lit(0).alias("_step"),
        F.struct(*[c for c in requests.columns if c not in key]).alias("_ask"),
    )
    stream = opening.unionByName(later).unionByName(asked, allowMissingColumns=True)
    # A balance of one account in one ledger: its changes and the targets that ask are bounded by the ledger.
    found = prefix_last(stream, key, ["_at", "_tag", "_step"], "_state", "_hit", bounded=True)
    wanted = [F.col(c) if c in key else F.col(f"_ask.{c}") for c in requests.columns]
    return found.filter("_ask is not null").select(*wanted, "_hit.funds", "_hit.units", "_hit.exponent")


def tx_pre_funds(meta: DataFrame) -> DataFrame:
    """Owner funds per touched offer from the transaction's own pre-balances: (tx_hash, offer_id, funds, units, exponent).

    ``funds`` is NULL where the balance is too large for DECIMAL(38,18); ``units`` and ``exponent`` are exact. Only balances of
    accounts with a touched offer in the record are read and shuffled.
    """
    touched = F.filter("result.meta.AffectedNodes", lambda n: n["CreatedNode"].isNull())
    offered = F.filter(F.transform(touched, lambda n: F.coalesce(n["ModifiedNode"], n["DeletedNode"])), lambda b: b["LedgerEntryType"] == "Offer")
    owner = lambda b: F.coalesce(*[b[image]["Account"] for image in ("PreviousFields", "FinalFields", "NewFields")])
    nodes = affected_nodes(meta.withColumn("_owners", F.transform(offered, owner)), keep=("_owners",))
    offers = nodes.filter((F.col("body.LedgerEntryType") == "Offer") & F.col("kind").isin("modified", "deleted"))
    offers = offers.select(
        "tx_hash", F.col("body.LedgerIndex").alias("offer_id"), pre("Account").alias("account"),
        A.currency_of(pre("TakerGets")).alias("currency"), F.coalesce(A.issuer_of(pre("TakerGets")), F.lit("")).alias("issuer"),
    ).filter("offer_id is not null and account is not null and currency is not null")
    drops = A.spendable_drops(A.drops_of(pre("Balance")), pre("OwnerCount"))
    roots = nodes.filter(F.col("body.LedgerEntryType") == "AccountRoot").select(
        "tx_hash", "step", pre("Account").alias("account"), F.lit(NATIVE).alias("currency"), F.lit("").alias("issuer"),
        drops.cast(VALUE).alias("funds"), drops.cast(A.UNITS).alias("units"), F.lit(0).alias("exponent"), "_owners",
    ).filter("array_contains(_owners, account) and units > 0").drop("_owners")
    # The sign of the exact units decides: an amount too large for ``funds`` keeps its row.
    lines, units = trust_lines(nodes, ("before",), "_owners"), F.col("before.units")
    holder, other = F.when(units > 0, F.col("low")).otherwise(F.col("high")), F.when(units > 0, F.col("high")).otherwise(F.col("low"))
    issued = lines.filter(units != 0).select(
        "tx_hash", "step", holder.alias("account"), "currency", other.alias("issuer"), F.abs(F.col("before.value")).cast(VALUE).alias("funds"),
        F.abs(units).cast(A.UNITS).alias("units"), F.col("before.exponent").alias("exponent"),
    )
    key = ["tx_hash", "account", "currency", "issuer"]
    last = F.max_by(F.struct("funds", "units", "exponent"), "step").alias("_last")
    balances = roots.unionByName(issued).groupBy(*key).agg(last)
    return offers.join(balances, key).select("tx_hash", "offer_id", "_last.*")
