"""The registry of the core's queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.intervals import page_periods
from .session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


P2_SQL = """
WITH a AS (SELECT case_id id, start_page s, end_page e FROM annotations WHERE start_page>=1 AND start_page<=end_page),
f0 AS (SELECT filing_id id, unnest(page_span) u FROM filing_parts),
f AS (SELECT id, u."start" s, u."end" e FROM f0 WHERE u."start">=1 AND u."start"<=u."end"),
r AS (SELECT 'annotations' origin, * FROM a UNION ALL SELECT 'filing_parts', * FROM f),
m AS (SELECT *, max(e) OVER (PARTITION BY origin, id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM r),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s>pe+1 THEN 1 ELSE 0 END) OVER (PARTITION BY origin, id ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM m),
p AS (SELECT origin, id, n, min(s) s, max(e) e FROM g GROUP BY ALL),
c AS (SELECT case_id id, max(page_count) pc FROM annotations GROUP BY 1),
w AS (SELECT p.*, lead(s) OVER (PARTITION BY origin, p.id ORDER BY s) ns, pc FROM p LEFT JOIN c ON p.origin='annotations' AND c.id=p.id),
x AS (
 SELECT origin, id, 'period' kind, s, e FROM p
 UNION ALL SELECT origin, id, 'gap', e+1, CASE WHEN origin='annotations' THEN least(coalesce(ns-1, pc), pc) ELSE ns-1 END FROM w
 UNION ALL SELECT 'annotations', c.id, 'gap', 1, least(coalesce(q.s-1, c.pc), c.pc) FROM c LEFT JOIN (SELECT id, min(s) s FROM p WHERE origin='annotations' GROUP BY 1) q USING (id))
SELECT origin, id AS entity_id, kind, CAST(s AS BIGINT) AS start_page, CAST(e AS BIGINT) AS end_page FROM x WHERE s<=e
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_periods(table(spark, d, "annotations"), table(spark, d, "filing_parts"))


def load_plans() -> None:
    """Imports the modules whose queries register themselves."""
    import importlib
    import pkgutil

    from . import plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__)):
        importlib.import_module(f"{plans.__name__}.{m}")


load_plans()
