"""Registration of queries with their SQL."""

from __future__ import annotations

import re

from sparkloom.sources.tables import NAMES, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(t), where t(name) is a table, under f's name; sql is the same in DuckDB."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Spark's wording and DuckDB's of what differs in SQL said once.
WORDING = {"SECONDS(": ("timestampdiff(SECOND, ", "date_sub('second', "), "MATCHES(": ("regexp_like(", "regexp_matches(")}


def sql_query(name: str, sql: str, duck: str | None = None) -> None:
    """A query that is said in SQL; duck: DuckDB's wording where it differs. Tables are {name}."""
    duck = duck or sql
    for word, (own, other) in WORDING.items():
        sql, duck = sql.replace(word, own), duck.replace(word, other)
    used = {n for n in NAMES if "{" + n + "}" in sql}
    inner = "|".join(NAMES)
    sql = re.sub(r"\{(?!(?:%s)\})" % inner, "{{", sql)
    sql = re.sub(r"(?<!\{%s)\}" % ")(?<!{".join(NAMES), "}}", sql)
    QUERIES[name] = lambda spark, sf_dir: spark.sql(sql, **{n: tables(spark, sf_dir)(n) for n in used})
    ORACLE_SQL[name] = re.sub(r"\{(%s)\}" % inner, r"\1", duck)
