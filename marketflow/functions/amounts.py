"""Column expressions over ledger amounts.

A raw amount is union typed: a JSON string holds native drops, a JSON object holds
``{currency, issuer, value}``. Readers declare such fields as STRING, so an object arrives as its
JSON text and a native amount as bare digits. Parsed amounts keep exact integers:
``value = units * 10^exponent`` with 16 significant digits for issued assets.

The larger expressions are written as SQL text and take SQL text (a column name, a field path or an
expression). ``_let`` binds an intermediate value through a one-element ``transform``, so it is
computed once however often it is named. Lambdas are interpreted: over the columns of a row ``parsed`` and
``summed`` do the same by steps that are compiled.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions.constants import (
    EXPONENT_MAX,
    EXPONENT_MIN,
    MANTISSA_DIGITS,
    NATIVE,
    RESERVE_BASE,
    RESERVE_PER_OBJECT,
    ZERO_EXPONENT,
)

UNITS = "decimal(38,0)"
VALUE = "decimal(38,18)"
NUMBER = r"^[+-]?(\\d*)\\.?(\\d*)(?:[eE]([+-]?\\d+))?$"
FULL, LEAST = f"{10**MANTISSA_DIGITS}BD", f"{10 ** (MANTISSA_DIGITS - 1)}BD"
ZERO_SQL = f"named_struct('units', cast(0 as {UNITS}), 'exponent', {ZERO_EXPONENT})"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# Looked up, not read from text: the cast fails where the power is out of range, and a failing cast costs more than the rest of an amount.
POWERS = f"array({', '.join(f'cast({10**i}BD as {UNITS})' for i in range(38))})"


def _pow10(power: str) -> str:
    """10^power as an exact integer for power in 0..37, else NULL."""
    return f"get({POWERS}, {power})"


def _pair(units: str, exponent: str) -> str:
    return f"named_struct('units', cast({units} as {UNITS}), 'exponent', cast({exponent} as int))"


Steps = list[tuple[str, str]]


def _same(name: str) -> str:
    return name


def _nested(steps: Steps, last: str) -> str:
    """Steps bound one inside the other, for use in a lambda or a condition."""
    for name, value in reversed(steps):
        last = _let(value, name, last)
    return last


def _sixteen_steps(units: str, exponent: str, v: Callable[[str], str] = _same) -> tuple[Steps, str]:
    """Steps, under the names that ``v`` gives them, and the result over them."""
    n = MANTISSA_DIGITS
    s, w, c, m = (v(x) for x in "swcm")
    row = f"named_struct('size', cast(abs({units}) as {UNITS}), 'sign', cast(signum({units}) as int), 'e', {exponent})"
    sized = f"named_struct('d', {s}.size, 'sign', {s}.sign, 'e', {s}.e, 'n', length(cast({s}.size as string)))"
    # The leading digits are a whole quotient: plain DECIMAL division would round.
    cut = (
        f"named_struct('head', cast({w}.d div {_pow10(f'{w}.n - {n}')} as {UNITS}), "
        f"'rest', cast({w}.d % {_pow10(f'{w}.n - {n}')} as {UNITS}), 'step', {_pow10(f'{w}.n - {n}')})"
    )
    up = f"{c}.rest * 2 > {c}.step or ({c}.rest * 2 = {c}.step and {c}.head % 2 = 1)"
    rounded = f"cast({c}.head + if({up}, 1, 0) as {UNITS})"
    long = _pair(f"if({m} >= {FULL}, {LEAST}, {m}) * {w}.sign", f"{w}.e + {w}.n - {n} + if({m} >= {FULL}, 1, 0)")
    short = _pair(f"try_multiply({w}.d, {_pow10(f'{n} - {w}.n')}) * {w}.sign", f"{w}.e + {w}.n - {n}")
    whole = f"case when {w}.d = 0 then {ZERO_SQL} when {w}.n <= {n} then {short} else {long} end"
    return [(s, row), (w, sized), (c, cut), (m, rounded)], whole


def sixteen_digits_sql(units: str, exponent: str) -> str:
    """An exact integer at ``exponent`` as a 16-digit ``struct<units, exponent>``, half-even."""
    return _nested(*_sixteen_steps(units, exponent))


def _canonical_steps(text: str, v: Callable[[str], str] = _same) -> tuple[Steps, str]:
    t, p, q = (v(x) for x in "tpq")
    part = lambda i: f"regexp_extract({t}, '{NUMBER}', {i})"
    parts = (
        f"if({t} rlike '{NUMBER}' and length({part(1)}) + length({part(2)}) > 0, named_struct("
        f"'digits', regexp_replace(concat({part(1)}, {part(2)}), '^0+(?=.)', ''), "
        f"'power', if({part(3)} = '', 0, coalesce(try_cast({part(3)} as int), 0)) - length({part(2)}), "
        f"'sign', if(startswith({t}, '-'), '-', '')), null)"
    )
    # Of longer texts 37 digits and one sticky digit are kept: it is 1 when any digit behind is not zero, so that a number just
    # above the half still rounds up. The dropped digits move the exponent.
    sticky = f"if(length({p}.digits) > 38, concat(substring({p}.digits, 1, 37), if(rtrim('0', substring({p}.digits, 38)) = '', '0', '1')), {p}.digits)"
    steps, scaled = _sixteen_steps(f"try_cast(concat({p}.sign, {sticky}) as {UNITS})", f"{p}.power + greatest(length({p}.digits) - 38, 0)", v)
    bounded = (
        f"case when {p} is null then null when {q}.exponent < {EXPONENT_MIN} then {ZERO_SQL} "
        f"when {q}.exponent <= {EXPONENT_MAX} then {q} end"
    )
    return [(t, f"trim({text})"), (p, parts), *steps, (q, scaled)], bounded


def canonical_sql(text: str) -> str:
    """Decimal text as ``struct<units, exponent>``: 16 digits, half-even beyond, underflow to zero."""
    return _nested(*_canonical_steps(text))


def _parse_steps(raw: str, v: Callable[[str], str] = _same, staged: bool = False) -> tuple[Steps, str]:
    r, x, y = (v(c) for c in "rxy")
    opened = (
        f"named_struct('o', if(startswith({r}, '{{'), from_json({r}, 'currency string, issuer string, value string'), null), "
        f"'drops', if(startswith({r}, '{{'), null, try_cast({r} as decimal(20,0))))"
    )
    steps, issued = _canonical_steps(f"{x}.o.value", v)
    numbered = (
        f"named_struct('currency', coalesce({x}.o.currency, '{NATIVE}'), 'issuer', {x}.o.issuer, "
        f"'n', case when {x}.drops is not null then {_pair(f'{x}.drops', '-6')} "
        f"when {x}.o is not null then {issued if staged else _nested(steps, issued)} end, "
        f"'value', coalesce(try_cast({x}.o.value as {VALUE}), cast({x}.drops / cast(1000000 as decimal(7,0)) as {VALUE})))"
    )
    lost = f"{y}.n.exponent < -18 and coalesce({y}.n.units % {_pow10(f'-18 - {y}.n.exponent')} <> 0, {y}.n.units <> 0)"
    finished = (
        f"if({y}.n is null, null, named_struct('currency', {y}.currency, 'issuer', {y}.issuer, 'units', {y}.n.units, "
        f"'exponent', {y}.n.exponent, 'value', {y}.value, 'inexact', {y}.value is null or ({lost})))"
    )
    return [(r, raw), (x, opened), *(steps if staged else []), (y, numbered)], finished


def parse_sql(raw: str) -> str:
    """Raw amount as ``struct<currency, issuer, units, exponent, value, inexact>``; NULL when invalid.

    ``inexact`` marks an amount whose digits do not fit the DECIMAL(38,18) projection; exact work
    uses ``units`` and ``exponent``.
    """
    return _nested(*_parse_steps(raw))


def aligned_sql(units: str, exponent: str, base: str) -> str:
    """Units rewritten at the smaller exponent ``base``; NULL when 38 digits are not enough."""
    product = f"cast(try_multiply({units}, {_pow10(f'({exponent}) - ({base})')}) as {UNITS})"
    return f"if({units} = 0, cast(0 as {UNITS}), {product})"


def _sum_steps(left: str, right: str, sign: int, native: str, v: Callable[[str], str] = _same, staged: bool = False) -> tuple[Steps, str]:
    g, h, k = (v(x) for x in "ghk")
    row = (
        f"named_struct('a', cast({left}.units as {UNITS}), 'ae', {left}.exponent, "
        f"'b', cast({right}.units * {sign} as {UNITS}), 'be', {right}.exponent, 'native', {native})"
    )
    based = f"named_struct('g', {g}, 'base', least(if({g}.a <> 0, {g}.ae, null), if({g}.b <> 0, {g}.be, null)))"
    exact = f"cast(try_add({aligned_sql(f'{h}.g.a', f'{h}.g.ae', f'{h}.base')}, {aligned_sql(f'{h}.g.b', f'{h}.g.be', f'{h}.base')}) as {UNITS})"
    steps, cut = _sixteen_steps(k, f"{h}.base", v)
    rounded = (
        f"case when {h}.g.a is null or {h}.g.b is null then null "
        f"when {h}.base is null then if({h}.g.native, {_pair('0', '-6')}, {ZERO_SQL}) "
        f"when {k} is null then if({h}.g.ae >= {h}.g.be, {_pair(f'{h}.g.a', f'{h}.g.ae')}, {_pair(f'{h}.g.b', f'{h}.g.be')}) "
        f"when {h}.g.native then {_pair(k, f'{h}.base')} else {cut if staged else _nested(steps, cut)} end"
    )
    return [(g, row), (h, based), (k, exact), *(steps if staged else [])], rounded


def signed_sum_sql(left: str, right: str, sign: int, native: str) -> str:
    """``left + sign * right`` of structs with (units, exponent) as ``struct<units, exponent>``.

    The sum is formed exactly at the smaller exponent, then brought back to 16 digits half-even as
    ledger arithmetic does; native amounts stay whole drops. When the exponents are too far apart to
    align, the smaller operand is below the last digit of the larger one and drops out.
    """
    return _nested(*_sum_steps(left, right, sign, native))


def _staged(df: DataFrame, found: dict[str, tuple[Steps, str]]) -> DataFrame:
    """Columns made by steps, each a column of its own beside those of the others: the planner compiles these, lambdas it interprets."""
    kept = df.columns
    for level in zip_longest(*[steps for steps, _ in found.values()]):
        df = df.withColumns({name: F.expr(value) for name, value in filter(None, level)})
    return computed(df, {out: last for out, (_, last) in found.items()}).select(*kept, *found)


def parsed(df: DataFrame, raws: dict[str, str]) -> DataFrame:
    """Add columns as :func:`parse_sql` makes them of raw amounts (SQL), compiled. All amounts of a row go through together."""
    return _staged(df, {out: _parse_steps(raw, lambda x, at=i: f"_p{at}_{x}", True) for i, (out, raw) in enumerate(raws.items())})


def summed(df: DataFrame, sums: dict[str, tuple[str, str, int, str]]) -> DataFrame:
    """Add columns as :func:`signed_sum_sql` makes them of (left, right, sign, native), compiled."""
    return _staged(df, {out: _sum_steps(*terms, lambda x, at=i: f"_p{at}_{x}", True) for i, (out, terms) in enumerate(sums.items())})


def computed(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Add columns, given as SQL or as such, behind a one-row generator.

    A later filter on such a column stays above it. Pushed through a projection, the filter would
    carry a copy of the whole expression for every mention and evaluate each copy per row.
    """
    entries = [(F.expr(value) if isinstance(value, str) else value).alias(name) for name, value in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*entries))))


def canonical(text: str) -> Column:
    return F.expr(canonical_sql(text))


def parse_amount(raw: str) -> Column:
    return F.expr(parse_sql(raw))


def signed_sum(left: str, right: str, sign: int, native: str) -> Column:
    return F.expr(signed_sum_sql(left, right, sign, native))


def number_double(units: Column, exponent: Column) -> Column:
    return units.cast("double") * F.pow(F.lit(10.0), exponent.cast("double"))


def same_amount_sql(left: str, right: str) -> str:
    """Equality of canonical amounts; zero has no exponent."""
    return f"{left}.units = {right}.units and ({left}.units = 0 or {left}.exponent = {right}.exponent)"


def is_issued(raw: Column) -> Column:
    return raw.startswith("{")


def currency_of(raw: Column) -> Column:
    return F.when(is_issued(raw), F.get_json_object(raw, "$.currency")).when(raw.isNotNull(), F.lit(NATIVE))


def issuer_of(raw: Column) -> Column:
    return F.when(is_issued(raw), F.get_json_object(raw, "$.issuer"))


def drops_of(raw: Column) -> Column:
    """Native drops of a raw amount; NULL for an issued one, without trying to read its text."""
    return F.when(~is_issued(raw), raw.try_cast("bigint"))


def asset_key(raw: Column) -> Column:
    """``currency:issuer`` with an empty issuer for the native asset."""
    return F.concat_ws(":", currency_of(raw), F.coalesce(issuer_of(raw), F.lit("")))


def book_quality(directory: Column) -> Column:
    """Encoded quality: the last 16 hex digits of a book directory. Lower is better."""
    return F.when(
        F.length(F.trim(directory)) >= 16,
        F.conv(F.substring(F.trim(directory), -16, 16), 16, 10).try_cast("decimal(20,0)"),
    )


def book_rate(directory: Column) -> Column:
    """Decoded quality as a DOUBLE rate: mantissa * 10^(exponent - 100)."""
    tail = F.substring(F.trim(directory), -16, 16)
    exponent = F.conv(F.substring(tail, 1, 2), 16, 10).cast("int") - 100
    mantissa = F.conv(F.substring(tail, 3, 14), 16, 10).cast("double")
    return mantissa * F.pow(F.lit(10.0), exponent.cast("double"))


def round_to_tick(mantissa: str, tick: str) -> Column:
    """Mantissa rounded up to ``tick`` significant digits; sizes of 16 and above leave it alone."""
    step = _pow10(f"{MANTISSA_DIGITS} - {tick}")
    raised = _let(step, "s", f"cast({mantissa} + s - 1 - ({mantissa} + s - 1) % s as {UNITS})")
    return F.expr(f"if({tick} is null or {tick} >= {MANTISSA_DIGITS}, cast({mantissa} as {UNITS}), {raised})")


def spendable_drops(balance: Column, owner_count: Column) -> Column:
    """Native balance less the account reserve."""
    owned = F.greatest(F.coalesce(owner_count.cast("bigint"), F.lit(0)), F.lit(0))
    return balance.cast("bigint") - (F.lit(RESERVE_BASE) + owned * RESERVE_PER_OBJECT)


def ascii_currency_hex(label: Column) -> Column:
    """Label of 1 to 20 ASCII characters as the 40-digit currency code; NULL otherwise."""
    fits = (F.length(label) >= 1) & (F.length(label) <= 20) & label.rlike(r"^[\x00-\x7F]*$")
    return F.when(fits, F.rpad(F.upper(F.hex(label)), 40, "0"))
