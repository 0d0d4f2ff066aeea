"""Registry of checked queries: a Spark callable, the output columns and, where SQL can say it, the SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql_views import FRAGMENTS
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_STATEMENTS: dict[str, str] = {}


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple((tok.split(":") + [""])[:2]) for tok in spec.split()]


def _spark_columns(spec: str):
    for name, kind in _parse(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind:
            c = F.round(c.cast("double"), int(kind))
        yield c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind in ("i", "s", "b"):
        return f"cast({q} as {dict(i='bigint', s='varchar', b='boolean')[kind]}) as {q}"
    return f"round(cast({q} as double), {kind}) as {q}" if kind else q


def with_fragments(body: str) -> str:
    """Prepend the shared views a statement uses, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, seen: frozenset[str]) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", text)):
            if word in FRAGMENTS and word not in ordered and word not in seen:
                visit(FRAGMENTS[word], seen | {word})
                ordered.append(word)

    visit(body, frozenset())
    head = ",\n".join(f"{n} as ({FRAGMENTS[n].strip()})" for n in ordered)
    return (f"with {head}\n" if head else "") + body.strip()


def query(name: str, spec: str, sql: str | None = None):
    """Register `fn(views) -> DataFrame` under `name`; `spec` fixes column order, types and rounding on both sides."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir)).select(*_spark_columns(spec))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            cols = ", ".join(_sql_column(n, k) for n, k in _parse(spec))
            _STATEMENTS[name] = f"select {cols} from ({sql.strip()}) as result"
        return fn

    return wrap


def oracles() -> dict[str, str]:
    """SQL twins, complete with the shared views they use."""
    return {name: with_fragments(sql) for name, sql in _STATEMENTS.items()}
