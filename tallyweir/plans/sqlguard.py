"""Read-only SQL over given tables: two allow-lists, a row cap and a time limit.

The first gate walks the parsed statement: plan nodes, table names and function
names. The second walks the analysed plan, where nothing is hidden any more:
every leaf must lie in one of the given tables, and no expression may be one of
Spark's miscellaneous functions, however it was written (``current_user`` needs
no brackets), and no expression without children may be anything but a column
of those tables, a constant, a part of a window or a function that may be called
(a session variable is none of these). Functions of chance and of the clock are
allowed: they say nothing about other callers. Tables are registered under names of their own and dropped again,
so callers of one session do not see each other's.
"""

from __future__ import annotations

import functools
import re
import threading
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Row, SparkSession

MAX_CHARS, MAX_ROWS, MAX_SECONDS = 8_000, 1_000, 10

#: Nodes that a parsed query may hold, by class name.
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin Union Intersect Except Distinct SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition OneRowRelation".split()
)
#: Groups of Spark's built-in functions that a query may not call: these reach outside it, or make relations.
REFUSED_GROUPS = frozenset(["misc_funcs", "table_funcs", "st_funcs"])
#: Functions of those groups that only look at their arguments.
HARMLESS = frozenset(["typeof", "equal_null"])
#: Further functions that reach outside the query whatever their group.
DENIED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_database current_schema current_catalog version spark_partition_id monotonically_increasing_id raise_error uuid".split())
#: Leaves of an analysed plan besides the given tables.
LEAVES = frozenset(["OneRowRelation", "CTERelationRef"])

#: Expressions without children besides functions: columns, constants, lambda variables and the bounds of windows.
TIPS = frozenset("AttributeReference OuterReference Literal NamedLambdaVariable UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ ScalarSubquery Exists ListQuery LateralSubquery".split())


class QueryRefused(ValueError):
    """The query is not a read-only SELECT over the allowed tables."""


def _items(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(i) for i in range(seq.size())]


def _values(mapping: JavaObject) -> list[JavaObject]:
    return _items(mapping.values().toSeq())


@functools.cache
def _function_classes(application: str) -> tuple[dict[str, str], frozenset[str], frozenset[str]]:
    """Group by name of the built-in functions, the classes that no analysed plan may hold and those it may; the same in every session."""
    spark = SparkSession.active()
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    groups, classes, allowed = {}, set(), set()
    for name in _items(registry.listFunction()):
        info = registry.lookupFunction(name).get()
        plain = name.funcName()
        groups[plain] = info.getGroup()
        simple = info.getClassName().rsplit(".", 1)[-1]
        refused = plain in DENIED or info.getGroup() in REFUSED_GROUPS and plain not in HARMLESS
        (classes if refused else allowed).add(simple)
    return groups, frozenset(classes - allowed), frozenset(allowed)


def _may_call(spark: SparkSession, name: str) -> bool:
    group = _function_classes(spark.sparkContext.applicationId)[0].get(name)
    return group is not None and name not in DENIED and (group not in REFUSED_GROUPS or name in HARMLESS)


def _statement(sql: str) -> str:
    return sql.strip().rstrip(";")


def guard(spark: SparkSession, sql: str, tables: tuple[str, ...] = ("data",)) -> None:
    """Raises :class:`QueryRefused` unless ``sql`` reads as one SELECT over ``tables`` and its own CTEs."""
    if not sql or not sql.strip():
        raise QueryRefused("the query is empty")
    if len(sql) > MAX_CHARS:
        raise QueryRefused(f"the query is longer than {MAX_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(_statement(sql))
    except Exception as error:
        raise QueryRefused("the query cannot be read as one SELECT statement") from error
    _walk(spark, plan, frozenset(t.lower() for t in tables))


def _walk(spark: SparkSession, plan: JavaObject, allowed: frozenset[str]) -> None:
    name = plan.getClass().getSimpleName()
    if name not in NODES:
        raise QueryRefused(f"{name} is not allowed")
    if name == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise QueryRefused(f"table {'.'.join(parts)} is not allowed")
    if name == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _walk(spark, pair._2(), allowed)
            allowed |= {pair._1().lower()}
    specs = _values(plan.windowDefinitions()) if name == "WithWindowDefinition" else []
    for expression in [*_items(plan.expressions()), *specs]:
        _walk_expression(spark, expression, allowed)
    for child in _items(plan.children()):
        _walk(spark, child, allowed)


def _walk_expression(spark: SparkSession, expression: JavaObject, allowed: frozenset[str]) -> None:
    name = expression.getClass().getSimpleName()
    if name == "UnresolvedFunction":
        parts = _items(expression.nameParts())
        if len(parts) != 1 or not _may_call(spark, parts[0].lower()):
            raise QueryRefused(f"function {'.'.join(parts)} is not allowed")
    if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _walk(spark, expression.plan(), allowed)
    for child in _items(expression.children()):
        _walk_expression(spark, child, allowed)


def _check_analysed(spark: SparkSession, plan: JavaObject, views: frozenset[str]) -> None:
    """Refuses an analysed plan with a leaf outside ``views`` or with a refused expression; what the caller's own tables hold is not looked at."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        if plan.desc().identifier().table() not in views:
            raise QueryRefused("that table is not allowed")
        return
    children = _items(plan.children())
    if not children and kind not in LEAVES:
        raise QueryRefused(f"{kind} is not allowed")
    for expression in _items(plan.expressions()):
        _check_expression(spark, expression, views)
    for child in children:
        _check_analysed(spark, child, views)


def _check_expression(spark: SparkSession, expression: JavaObject, views: frozenset[str]) -> None:
    kind, children = expression.getClass().getSimpleName(), _items(expression.children())
    _, refused, allowed = _function_classes(spark.sparkContext.applicationId)
    if kind in refused or kind in ("ScalaUDF", "PythonUDF", "CallMethodViaReflection") or not children and kind not in TIPS and kind not in allowed:
        raise QueryRefused(f"{kind} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check_analysed(spark, expression.plan(), views)
    for child in children:
        _check_expression(spark, child, views)


def limited(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rows: int = MAX_ROWS) -> DataFrame:
    """The guarded query over ``tables`` as a DataFrame of at most ``rows`` rows, in the query's order."""
    guard(spark, sql, tuple(tables))
    views = {name: f"guarded_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        # the line break ends a trailing comment of the query
        found = spark.sql(f"WITH {named} SELECT * FROM ({_statement(sql)}\n)")
        _check_analysed(spark, found._jdf.queryExecution().analyzed(), frozenset(views.values()))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return found.limit(rows)


#: Pieces of a statement: quoted text, comments and space, and all else sign by sign or word by word.
_PIECES = re.compile(r"""(?P<quoted>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<skip>--[^\n]*|/\*.*?\*/|\s+)|(?P<other>\w+|.)""", re.S)


def same_query(first: str, second: str) -> bool:
    """Whether two statements differ in nothing but case outside quotes, space and comments."""
    one, two = ([m["quoted"] or m["other"].lower() for m in _PIECES.finditer(_statement(sql)) if not m["skip"]] for sql in (first, second))
    return one == two


def run(spark: SparkSession, sql: str, data: DataFrame, rows: int = MAX_ROWS, seconds: float = MAX_SECONDS) -> list[Row]:
    """Rows of the guarded query; after ``seconds`` its jobs are cancelled and TimeoutError is raised."""
    context, group, late = spark.sparkContext, f"query-{uuid.uuid4().hex}", threading.Event()
    df = limited(spark, sql, {"data": data}, rows)

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    keys = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    kept = {key: context.getLocalProperty(key) for key in keys}
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return df.collect()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"the query was stopped after {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        for key, value in kept.items():
            context.setLocalProperty(key, value)
