"""Named queries over the test tables, each with the SQL that says the same in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def steady_rounds(sql: str) -> str:
    """``round(x, n)`` written out as the arithmetic that the engine's own rounding uses."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, end, comma = 1, start + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        value, digits = sql[start + 6 : comma], int(sql[comma + 1 : end - 1])
        out.append(f"{sql[at:start]}(floor(({steady_rounds(value)}) * 1e{digits} + 0.5) / 1e{digits})")
        at = end
    return "".join(out) + sql[at:]


class Catalog:
    """Queries and, where SQL can say it, their equivalents."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = query
        if sql is not None:
            self.oracle[name] = steady_rounds(sql)

    def query(self, name: str, sql: str | None = None):
        def register(query: Query) -> Query:
            self.add(name, query, sql)
            return query

        return register


def load() -> Catalog:
    from spindrift.catalog import encoding, expressions, features, joins, metrics, reports, scans, search, selection

    catalog = Catalog()
    for part in (scans, expressions, features, joins, selection, metrics, reports, search, encoding):
        part.register(catalog)
    return catalog
