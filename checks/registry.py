"""Where checks register a Spark query and, if there is one, its SQL twin."""

from __future__ import annotations

import functools

from pricewell.plans.session import use_local_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

PRICES = """prices AS (
  SELECT n.n_name AS state,
         concat(n.n_name, '-D', CAST(s.s_suppkey % 4 AS VARCHAR)) AS district,
         s.s_name AS market, p.p_brand AS commodity, p.p_type AS variety,
         l.l_returnflag AS grade, CAST(l.l_shipdate AS DATE) AS arrival_date,
         p.p_retailprice AS min_price, p.p_retailprice * 40 AS max_price,
         l.l_extendedprice / nullif(l.l_quantity, 0) AS modal_price,
         CAST(year(l.l_shipdate) AS INT) AS year, CAST(month(l.l_shipdate) AS INT) AS month
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def add(name, fn, sql: str | None = None, ctes: list[str] | None = None, recursive: bool = False):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use ``prices`` and the given CTEs."""
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")

    @functools.wraps(fn)
    def query(spark, sf_dir):
        use_local_folder(spark)
        return fn(spark, sf_dir)

    QUERIES[name] = query
    if sql is not None:
        head = "WITH RECURSIVE " if recursive else "WITH "
        SQL[name] = head + ",\n".join([PRICES] + (ctes or [])) + "\n" + sql
