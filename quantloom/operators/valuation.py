"""Annual line items of suppliers' nations, and the as-of price join; the rules on filings are in fundamentals.py."""

from __future__ import annotations

from quantloom.plans.engine import Base, Query
from quantloom.sources.bars import BARS, from_table

_FACTS = Query(
    from_table("lineitem"), [],
    """SELECT symbol, fy, revenue, cogs, revenue - cogs AS gross, revenue - cogs - opex AS income, revenue * 0.3 - opex * 0.5 AS cash_flow, assets, debt, shares FROM
        (SELECT n.n_name AS symbol, CAST(year(l_shipdate) AS INT) AS fy, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * 0.6 + l_quantity) AS cogs,
            sum(l_extendedprice * l_tax * 6) AS opex, sum(l_extendedprice) * 1.7 AS assets, sum(l_extendedprice * l_discount) * 9 AS debt, count(*) AS shares
        FROM {t} l JOIN {s} s ON l.l_suppkey = s.s_suppkey JOIN {n} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, year(l_shipdate))""",
    {"s": from_table("supplier"), "n": from_table("nation")},
)
FACTS = _FACTS.as_base()
_W = "PARTITION BY symbol ORDER BY fy"


_PAIRED = "SELECT *, " + ", ".join(f"lag({c}) OVER ({_W}) AS p_{c}" for c in ("income", "assets", "revenue")) + ", row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) AS back FROM {t}"


def as_of(targets: Base, prices: Base) -> Query:
    """Latest close on or before each target date, by one window over the union of both."""
    return Query(
        targets, [],
        """SELECT symbol, ts, close FROM (SELECT symbol, ts, is_target, last_value(px) OVER (PARTITION BY symbol, grp ORDER BY ts, is_target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_px,
            max(px) OVER (PARTITION BY symbol, grp) AS close FROM (SELECT *, sum(CASE WHEN is_target = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, is_target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
            FROM (SELECT symbol, ts, 1 AS is_target, CAST(NULL AS DOUBLE) AS px FROM {t} UNION ALL SELECT symbol, ts, 0, close FROM {p}))) WHERE is_target = 1""",
        {"p": prices},
    )


_MONTHS = Query(from_table("orders"), [], "SELECT DISTINCT 'NO' AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts FROM {t}").as_base()


def declared() -> dict[str, Query]:
    return {
        "annual_facts": Query(FACTS, [], "SELECT symbol, fy, round(revenue, 5) AS revenue, round(gross, 5) AS gross, round(income, 5) AS income, shares FROM {t}"),
        "snapshot": Query(FACTS, [], f"SELECT symbol, fy, round((revenue - p_revenue) / abs(p_revenue), 6) AS growth, round(gross / revenue, 6) AS gross_margin, round(income / revenue, 6) AS net_margin FROM ({_PAIRED}) WHERE back = 1"),
        "asof_price_join": as_of(_MONTHS, BARS),
    }
