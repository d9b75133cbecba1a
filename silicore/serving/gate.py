"""Gate for untrusted SQL: one query, over registered views, with harmless functions.

The text is parsed first; commands, inserts, scripts and references to files or table
functions are refused, also within subqueries and CTEs. Then the analyzed plan is
checked again: every relation in it must belong to a registered view.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Nodes that read and combine; a parsed query made of anything else is refused.
PARSED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Join", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedSubqueryColumnAliases",
    "UnresolvedHaving", "WithWindowDefinition", "Pivot", "Unpivot", "Generate", "UnresolvedInlineTable", "OneRowRelation", "LateralJoin", "Sample", "ResolvedInlineTable", "LocalRelation", "UnresolvedOrdinal", "UnresolvedOrderBy", "OrderBy", "UnresolvedPivot", "ExpandedLimit", "UnresolvedTransposed", "Tail",
}
FUNCTIONS = {"java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "read_files", "from_avro", "to_avro", "current_user", "session_user", "user", "current_database", "current_catalog", "version", "sql", "python_worker_logs"}


class Refused(ValueError):
    """The query is not one that may run."""


def _seq(s) -> list:
    it = s.iterator()
    out = []
    while it.hasNext():
        out.append(it.next())
    return out


def _plans(node):
    """The node, its children, and the plans inside its expressions and CTEs."""
    yield node
    for c in _seq(node.children()):
        yield from _plans(c)
    if node.getClass().getSimpleName() == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            yield from _plans(pair._2())
    for e in _seq(node.expressions()):
        yield from _inside(e)


def _inside(e):
    kind = e.getClass().getSimpleName()
    if kind in ("UnresolvedFunction",):
        name = _seq(e.nameParts())[-1].lower()
        if name in FUNCTIONS:
            raise Refused(f"the function {name} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        yield from _plans(e.plan())
    for c in _seq(e.children()):
        yield from _inside(c)


def check(spark: SparkSession, sql: str, views: set[str]) -> str:
    """The single query in ``sql``, or ``Refused``."""
    text = re.sub(r";\s*$", "", sql.strip())
    if not text:
        raise Refused("no query")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise Refused(str(e)) from e
    known = {v.lower() for v in views}
    ctes: set[str] = set()
    seen = list(_plans(parsed))
    for node in seen:
        if node.getClass().getSimpleName() == "UnresolvedWith":
            ctes |= {pair._1().lower() for pair in _seq(node.cteRelations())}
    for node in seen:
        kind = node.getClass().getSimpleName()
        if kind not in PARSED:
            raise Refused(f"{kind} is not part of a plain query")
        if kind == "UnresolvedRelation":
            name = [str(p).lower() for p in _seq(node.multipartIdentifier())]
            if len(name) != 1 or name[0] not in known | ctes:
                raise Refused(f"there is no view {'.'.join(name)}")
    return text


def run(spark: SparkSession, sql: str, views: set[str]) -> DataFrame:
    text = check(spark, sql, views)
    try:
        df = spark.sql(text)
    except AnalysisException as e:
        raise Refused(str(e)) from e
    for node in _plans(df._jdf.queryExecution().analyzed()):
        if node.getClass().getSimpleName() in ("ScriptTransformation", "Command", "HiveTableRelation"):
            raise Refused("only views can be read")
    return df
