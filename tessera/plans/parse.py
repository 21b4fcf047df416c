"""Looking at SQL through Spark's own parser and analyser, without running it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Nodes of a parsed plan that only read.
READ_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Join UnresolvedRelation UnresolvedInlineTable SubqueryAlias UnresolvedSubqueryColumnAliases "
    "With UnresolvedWith Union Intersect Except Distinct OneRowRelation UnresolvedHaving WithWindowDefinition Window Generate Pivot UnresolvedPivot Unpivot UnresolvedUnpivot "
    "LateralJoin Sample Expand UnresolvedTableValuedFunction UnresolvedHint LocalRelation Tail RepartitionByExpression Repartition UnionLoop UnionLoopRef CTERelationDef CTERelationRef "
    "AsOfJoin UnresolvedOrdinal ResolvedInlineTable Range View ParameterizedQuery NameParameterizedQuery PosParameterizedQuery PipeOperator".split()
)


def statements(sql: str) -> int:
    """How many statements a text has: separators outside of literals, quoted names and comments count."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    return sum(1 for part in bare.split(";") if part.strip())


def parsed(spark: SparkSession, sql: str) -> Any:
    """The unresolved plan (a JVM object). Raises ``ParseException`` for text that isn't SQL."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _items(seq: Any) -> Iterator[Any]:
    for i in range(seq.size()):
        yield seq.apply(i)


def nodes(plan: Any) -> Iterator[Any]:
    """All nodes of a plan, those of common table expressions and subqueries too."""
    yield plan
    for child in _items(plan.children()):
        yield from nodes(child)
    for child in _items(plan.innerChildren()):
        if hasattr(child, "innerChildren") and child.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical"):
            yield from nodes(child)
    for expression in _items(plan.expressions()):
        yield from _subqueries(expression)


def _subqueries(expression: Any) -> Iterator[Any]:
    if "Subquery" in expression.nodeName() or expression.nodeName() in ("exists", "scalarsubquery", "listquery", "lateralsubquery"):
        try:
            yield from nodes(expression.plan())
        except Exception:
            pass
    for child in _items(expression.children()):
        yield from _subqueries(child)


def node_names(spark: SparkSession, sql: str) -> set[str]:
    return {n.nodeName() for n in nodes(parsed(spark, sql))}


def relations(spark: SparkSession, sql: str) -> list[list[str]]:
    """Names, in parts, that a statement reads from."""
    out = []
    for n in nodes(parsed(spark, sql)):
        if n.nodeName() == "UnresolvedRelation":
            out.append(list(_items(n.multipartIdentifier())))
    return out


def table_functions(spark: SparkSession, sql: str) -> list[str]:
    out = []
    for n in nodes(parsed(spark, sql)):
        if n.nodeName() == "UnresolvedTableValuedFunction":
            out.append(".".join(_items(n.name())).lower())
    return out


def is_sql(spark: SparkSession, sql: str) -> str | None:
    """Why a text doesn't parse; None if it does."""
    try:
        parsed(spark, sql)
    except ParseException as e:
        return str(e).split("\n")[0]
    except Exception as e:  # the gateway's own error type, where no Python class stands for it
        return str(e).split("\n")[0]
    return None


def columns_read(df: DataFrame) -> dict[str, list[str]] | None:
    """For each source of a query the columns its plan's scans read; None if a source can't be told."""
    found: dict[str, set[str]] = {}
    for leaf in _items(df._jdf.queryExecution().sparkPlan().collectLeaves()):
        name = leaf.nodeName().strip()
        if name.startswith(("LocalTableScan", "Scan OneRowRelation", "Range", "OneRowRelation")):
            continue
        if name.startswith("Scan ") and hasattr(leaf, "relation"):
            try:
                name = str(leaf.relation().location().rootPaths().apply(0))
            except Exception:  # a source that isn't made of files
                return None
        found.setdefault(name, set()).update(a.name() for a in _items(leaf.output()))
    return {s: sorted(c) for s, c in found.items()}
