"""Scans, universes and single checks over bars; the data-quality engine is in quality_checks.py."""

from __future__ import annotations

from quantloom.functions.windows import prev
from quantloom.plans.engine import Query, tally
from quantloom.sources.bars import RAW_BARS, from_table

JUMP = 0.20

_GAPS = [
    {"pts": prev("ts"), "pclose": prev("close")},
    # weekdays strictly between two bars: whole weeks, then the rest day by day
    {"gap": "@days(ts; pts)@ - 1"},
    {"weekdays": "CASE WHEN gap > 0 THEN CAST(floor(gap / 7) * 5 AS BIGINT) + "
        + " + ".join(f"CASE WHEN gap % 7 >= {k} AND (@weekday(pts)@ + {k}) % 7 < 5 THEN 1 ELSE 0 END" for k in range(1, 7)) + " ELSE 0 END"},
    {"move": "abs(close / nullif(pclose, 0) - 1)"},
]



def declared() -> dict[str, Query]:
    line = from_table("lineitem")
    return {
        "dq_missing_bars": Query(RAW_BARS, _GAPS, "SELECT symbol, ts, CAST(weekdays AS BIGINT) AS n_missing FROM {t} WHERE weekdays > 0"),
        "dq_price_anomaly": Query(RAW_BARS, _GAPS, f"SELECT symbol, ts, round(move, 6) AS move FROM {{t}} WHERE move > {JUMP}"),
        "bars_range_scan": Query(
            RAW_BARS, [], "SELECT symbol, ts, close FROM {t} WHERE symbol = 'NO' AND ts >= DATE '1996-01-01' AND ts < DATE '1997-01-01'",
        ),
        "row_validation": Query(
            RAW_BARS, [],
            f"SELECT symbol, {tally('open > 0 AND high > 0 AND low > 0 AND volume >= 0 AND low <= least(open, close) AND high >= greatest(open, close)')} AS n_valid, count(*) AS n FROM {{t}} GROUP BY symbol",
        ),
        "upsert_bars": Query(
            line, [],
            """SELECT symbol, ts, px FROM (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS px,
                row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM {t}) WHERE k = 1""",
        ),
        "ticker_filter": Query(
            line, [], """SELECT DISTINCT symbol FROM (SELECT upper(trim(l_returnflag || l_linestatus)) AS symbol FROM {t} UNION ALL SELECT upper(trim(p_brand)) FROM {p})
                WHERE @fits(symbol; ^[A-Z][A-Z]?[A-Z]?[A-Z]?[A-Z]?([.-][A-Z])?$)@""", {"p": from_table("part")},
        ),
        "shard_universe": Query(
            from_table("customer"), [],
            "SELECT symbol, CAST((k - 1) % 4 AS BIGINT) AS shard FROM (SELECT c_mktsegment AS symbol, row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM {t}))",
        ),
        "merge_universes": Query(from_table("customer"), [], "SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM {t} UNION SELECT upper(trim(n_name)) FROM {n}", {"n": from_table("nation")}),
        "parse_json": Query(from_table("events"), [], "SELECT event_id, CAST(@json(props; k)@ AS BIGINT) AS k FROM {t}"),
        "hourly_bars": Query(
            from_table("events"), [],
            """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS STRING) AS hour, round(min_by(value, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
                round(max_by(value, event_id), 6) AS close, count(*) AS n FROM {t} GROUP BY event_type, date_trunc('hour', ts)""",
        ),
    }
