"""Survey-like views over the driver tables.

The SQL is plain enough to run unchanged on Spark and on the oracle engine: customers play
survey clusters, orders households, order lines household members.
"""

from __future__ import annotations

SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

_PHRASES = [
    "'piped into dwelling'", "'piped to yard/plot'", "'public tap/standpipe'", "'tube well or borehole'",
    "'protected well'", "'unprotected well'", "'protected spring'", "'unprotected spring'", "'rainwater'",
    "'tanker truck'", "'cart with small tank'", "'river/dam/lake/ponds/stream/canal/irrigation channel'",
    "'bottled water'", "'sachet water'", "'open well in yard'", "'gravity flow scheme'",
    "'neighbor' || chr(39) || 's tap'", "'neighborhood'", "'spring'", "'public fountain'", "'water in plastic bag'",
    "'other'", "NULL", "'public borehole'", "'piped to neighbour' || chr(39) || 's house'",
    "'motorcycle with three wheels'",
]


def _choose(expr: str, values: list[str]) -> str:
    return f"CASE {expr} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


VIEWS: dict[str, tuple[str, list[str]]] = {
    # one row per survey cluster
    "clusters": (
        """
        SELECT c.c_custkey AS cluster, r.r_name AS adm0_name, n.n_name AS adm1_name,
               n.n_name || ' ' || c.c_mktsegment AS adm2_name, r.r_name AS country,
               chr(65 + n.n_nationkey) || chr(65 + n.n_regionkey) AS cc,
               CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'U' ELSE 'R' END AS URBAN_RURA,
               -35 + CAST((c.c_custkey * 7919) % 70000 AS DOUBLE) / 1000 AS LATNUM,
               -20 + CAST((c.c_custkey * 104729) % 70000 AS DOUBLE) / 1000 AS LONGNUM,
               CAST(2010 + c.c_custkey % 10 AS INT) AS DHSYEAR,
               CAST(10 + c.c_custkey % 21 AS BIGINT) AS households,
               c.c_acctbal / 997 AS Actual,
               0.8 * c.c_acctbal / 997 + CAST((c.c_custkey * 37) % 101 AS DOUBLE) / 51 AS Prediction
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
             JOIN {region} r ON n.n_regionkey = r.r_regionkey
        """,
        ["customer", "nation", "region"],
    ),
    # one row per household, with answers as text
    "households": (
        f"""
        SELECT o.o_orderkey AS household, c.cluster, c.cc, c.adm0_name, c.adm1_name, c.adm2_name, c.URBAN_RURA,
               c.cc || 'HR' || CAST(year(o.o_orderdate) - 1993 AS VARCHAR(4)) || substr(c.adm0_name, 1, 1) AS survey,
               CAST(year(o.o_orderdate) AS INT) AS year, CAST(month(o.o_orderdate) AS INT) AS month,
               CAST(day(o.o_orderdate) AS INT) AS day, CAST(year(o.o_orderdate) - 1993 AS INT) AS version,
               {_choose("o.o_orderkey", _PHRASES)} AS source,
               CASE WHEN o.o_orderkey % 11 = 0 THEN 'on premises' WHEN o.o_orderkey % 13 = 0 THEN NULL
                    WHEN o.o_orderkey % 17 = 0 THEN 'nan' WHEN o.o_orderkey % 19 = 0 THEN '300+'
                    WHEN o.o_orderkey % 23 = 0 THEN '' ELSE CAST(o.o_orderkey % 90 AS VARCHAR(9)) END AS minutes,
               CASE WHEN o.o_orderkey % 3 = 0 THEN 'in own dwelling' WHEN o.o_orderkey % 5 = 0 THEN 'in own yard/plot'
                    WHEN o.o_orderkey % 7 = 0 THEN 'elsewhere' END AS location,
               CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_orderpriority END AS fuel,
               CASE WHEN o.o_orderkey % 4 = 0 THEN '1' WHEN o.o_orderkey % 4 = 1 THEN '0'
                    WHEN o.o_orderkey % 4 = 2 THEN 'yes' ELSE 'no' END AS radio,
               o.o_totalprice AS income, o.o_orderstatus AS status
        FROM {{orders}} o JOIN {{clusters}} c ON o.o_custkey = c.cluster
        """,
        ["orders", "clusters"],
    ),
    # monthly phase per area
    "phase_panel": (
        """
        SELECT c.adm2_name, c.adm1_name, c.adm0_name, CAST(year(o.o_orderdate) AS INT) AS year,
               CAST(month(o.o_orderdate) AS INT) AS month,
               CAST(1 + count(*) % 5 AS DOUBLE) AS CS,
               CASE WHEN count(*) % 4 = 0 THEN NULL ELSE CAST(count(*) % 3 AS DOUBLE) END AS HA0
        FROM {orders} o JOIN {clusters} c ON o.o_custkey = c.cluster
        GROUP BY c.adm2_name, c.adm1_name, c.adm0_name, CAST(year(o.o_orderdate) AS INT), CAST(month(o.o_orderdate) AS INT)
        """,
        ["orders", "clusters"],
    ),
    # monthly series per nation
    "series": (
        """
        SELECT c.adm1_name AS area, CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 AS BIGINT) AS idx,
               sum(o.o_totalprice) / count(*) AS price, CAST(count(*) AS DOUBLE) AS affected
        FROM {orders} o JOIN {clusters} c ON o.o_custkey = c.cluster
        GROUP BY c.adm1_name, CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 AS BIGINT)
        """,
        ["orders", "clusters"],
    ),
    # tiles of eight by eight pixels
    "tiles": (
        """
        SELECT vec_id AS tile_id, CAST(label % 3 AS INT) AS band, 8 AS height, 8 AS width, embedding AS px
        FROM {embeddings}
        """,
        ["embeddings"],
    ),
}


def oracle_views(*names: str) -> str:
    """``WITH`` clause of the views for the oracle engine, in order of need."""
    order: list[str] = []

    def need(n: str) -> None:
        for p in VIEWS[n][1]:
            if p in VIEWS:
                need(p)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    plain = {s: s for s in SOURCES} | {v: v for v in VIEWS}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0].format(**plain)})" for n in order)
