"""Result shaping shared by the registered queries, and SQL fragments of the derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT, fractions as DOUBLE rounded to ``digits``, dates as text."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(field.name))
    return df.select(*out)


def r(expression: str, digits: int = 6) -> str:
    """SQL counterpart of the DOUBLE rule of :func:`plain`."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def n(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


ORDERS = (
    "o AS (SELECT o_orderkey k, o_custkey u, CAST(round(o_totalprice * 100) AS BIGINT) c, o_orderdate ts, "
    "CAST(o_orderdate AS DATE) d, o_orderstatus st, o_orderpriority pr FROM orders)"
)

SWAPS = (
    ORDERS + ", sw AS (SELECT k, 'a' || k tx, k // 10 li, k % 10 ti, d, ts, 'P' || (u % 7) pool, 'T' || (u % 7) token, "
    "'I' || (u % 3) issuer, CAST(c AS DOUBLE) / 100 nres, CAST(c * 3 AS DOUBLE) / 100 tres, k % 3 = 0 nin FROM o)"
)

LEGS = (
    "lg AS (SELECT l_orderkey k, 'A' || l_orderkey tx, l_orderkey // 10 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END li, "
    "l_orderkey % 10 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END ti, 'T' || (l_suppkey % 7) token, "
    "'I' || (l_suppkey % 3) issuer, l_partkey % 2 = 0 even, l_shipdate FROM lineitem)"
)

SEQUENCE = (
    SWAPS + ", " + LEGS + ", seq AS (SELECT upper(tx) tx_hash, min(li) ledger_index, max(li) li2, min(ti) transaction_index, "
    "max(ti) ti2, max(a) has_amm, max(b) has_clob FROM (SELECT tx, li, ti, 1 a, 0 b FROM sw UNION ALL "
    "SELECT tx, li, ti, 0, 1 FROM lg) GROUP BY 1)"
)

META = (
    ORDERS + ", m AS (SELECT *, 'A' || k tx, k // 10 li, k % 10 ti, 'T' || (u % 7) cur, 'I' || (u % 3) iss, (k // 5) % 2 = 0 nin, "
    "'U' || (u % 50) who, 'PL' || (u % 7) pool, 'W' || (u % 13) maker, 'W' || ((u + 1) % 13) maker2, k % 5 < 2 pay, "
    "k % 5 IN (2, 3) offer, (k // 10) % 2 = 1 b10, (k // 20) % 2 = 1 b20, (k // 40) % 2 = 1 b40, (k // 20) % 4 turn, "
    "(k // 15) % 4 route FROM o)"
)

INTENTS = (
    META + ", it0 AS (SELECT *, pay AND k % 3 = 0 same, CASE WHEN nin THEN 'XRP' ELSE cur END icur0, "
    "CASE WHEN nin THEN cur ELSE 'XRP' END ocur FROM m WHERE pay OR offer), "
    "it AS (SELECT *, CASE WHEN pay THEN 'PAYMENT' ELSE 'OFFERCREATE' END tt, CASE WHEN same THEN ocur ELSE icur0 END icur, "
    "CASE WHEN same AND nin THEN who WHEN NOT same AND NOT nin THEN iss END iiss, CASE WHEN nin THEN iss END oiss, "
    "pay AND b10 partial, pay AND b20 no_direct, pay AND b40 lq, pay AND route <> 0 has_paths, "
    "CASE WHEN pay THEN CASE route WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END ELSE 0 END n_paths, pay AND route = 2 ext, "
    "offer AND b10 sell, offer AND turn IN (1, 3) ioc, offer AND turn IN (2, 3) fok, "
    "pay AND b10 AND k % 7 IN (0, 1) has_min, pay AND b10 AND k % 7 = 0 min_max, "
    "CASE WHEN nin = same THEN c / 1000.0 ELSE c / 100000.0 END ival, CASE WHEN nin THEN c / 1000.0 ELSE c / 100000.0 END oval, "
    "CASE WHEN offer AND k % 6 = 0 THEN k END cancel FROM it0 WHERE NOT (offer AND turn = 3))"
)


def sql(cte: str, body: str) -> str:
    return f"WITH {cte} {body}"


def student_t_sql(stats: str, key: str) -> str:
    """CTEs up to ``tq`` (t statistic ``t``, p-value ``p`` per ``key``) over ``stats`` with (key, n, a mean, d deviation).

    For whole degrees of freedom the tails of Student's t are a finite series in the cosine of atan(|t| / sqrt(df)), summed here
    term by term; the engine evaluates the incomplete beta function instead.
    """
    step = "term * cos(th) * cos(th) * (m + 1) / (m + 2)"
    odd = "1 - 2 / pi() * (any_value(th) + sin(any_value(th)) * arg_max(tot, m))"
    return (
        f"ts AS (SELECT *, CASE WHEN n > 1 AND d > 0 THEN a / (d / sqrt(n)) END t, n - 1 v FROM {stats}), "
        "tw AS (SELECT *, atan(abs(t) / sqrt(v)) th FROM ts WHERE t IS NOT NULL), "
        f"tr AS (SELECT {key}, v, th, v % 2 m, CASE WHEN v % 2 = 1 THEN cos(th) ELSE 1 END term, CASE WHEN v = 1 THEN 0 WHEN v % 2 = 1 THEN cos(th) ELSE 1 END tot FROM tw "
        f"UNION ALL SELECT {key}, v, th, m + 2, {step}, tot + {step} FROM tr WHERE m + 2 <= v - 2), "
        f"tp AS (SELECT {key}, CASE WHEN any_value(v) % 2 = 1 THEN {odd} ELSE 1 - sin(any_value(th)) * arg_max(tot, m) END p FROM tr GROUP BY ALL), "
        f"tq AS (SELECT ts.*, CASE WHEN n < 1 THEN NULL WHEN t IS NULL THEN CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END ELSE p END p FROM ts LEFT JOIN tp USING ({key}))"
    )
