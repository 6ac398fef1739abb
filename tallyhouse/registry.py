"""The register of queries: a function of a Source under its name, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.plans.mapping import AS_OF, TABLES, Source, dialect, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(relations: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False) -> Callable:
    """Register a function of a Source under its name; ``sql`` follows the common table expressions of ``relations``.

    Operators keep decimals; results are compared as doubles, so both engines hand out the same type.
    """

    def register(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            found = f(Source(spark, folder))
            return found.withColumns({c: F.col(c).cast("double") for c, kind in found.dtypes if kind.startswith("decimal")})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_relations(relations, sql, recursive) if relations else sql
        return f

    return register


def as_of(at: str = AS_OF) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def made(s: Source, sql: str, **dealt_by: str) -> DataFrame:
    """Rows of SQL over the supplied tables that both engines read; ``dealt_by`` (table: column) deals a table's rows out by a
    column before they are expanded or grouped, so that what is keyed by that column later needn't move again."""
    used = {t: s.table(t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    used |= {t: used[t].repartition(column) for t, column in dealt_by.items()}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return s.spark.sql(dialect(sql, True), **used)
