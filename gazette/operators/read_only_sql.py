"""Ad-hoc read-only SQL over temporary views."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..session import shared_folder

_ALLOWED = re.compile(r"^\s*(SELECT|WITH|EXPLAIN)\b", re.IGNORECASE)
_EXPLAIN = re.compile(r"^\s*EXPLAIN\b\s*(EXTENDED|CODEGEN|COST|FORMATTED)?", re.IGNORECASE)
REFUSED = "Error: Only SELECT/WITH/EXPLAIN queries are allowed."
REFUSED_CALL = "Error: Functions that call other code are not allowed."

#: Where the engine's own expressions and plan nodes are defined; functions that a session has registered are elsewhere,
#: or among the names below, as are the built-in ones that call any method by its name.
_OWN = ("org.apache.spark.sql.catalyst.", "org.apache.spark.sql.execution.", "org.apache.spark.sql.internal.", "org.apache.spark.sql.types.")
_OTHER_CODE = re.compile(r"Reflect|UDF|UDAF|UDTF|Aggregator|Hive|ScalarFunction|StaticInvoke|^Invoke|ApplyFunctionExpression|ObjectOperator|TypedColumn|Python|Script")


def read_only_sql(spark: SparkSession, query: str) -> DataFrame:
    """Rows of a query; a refused or failing one gives a row with its error text.

    The query runs as a sub-query, which the grammar allows to hold no command, so ``WITH … INSERT`` fails to
    parse instead of writing. What is judged is the analysed plan, so no spelling of a name passes: it may hold the
    engine's own expressions only, no registered functions and none that call methods by name. Only tables and views can be
    read, no files by path. The query runs once; its rows are kept in the shared folder.
    """
    if not _ALLOWED.match(query):
        return _error(spark, REFUSED)
    explain = _EXPLAIN.match(query)
    body = query[explain.end() :] if explain else query
    wrapped = "SELECT * FROM (\n" + body.strip().rstrip(";") + "\n)"
    files = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(files, "true")
    spark.conf.set(files, "false")
    try:
        rows = spark.sql(wrapped)
        if any(map(_calls_other_code, _nodes(spark, rows._jdf.queryExecution().analyzed()))):
            return _error(spark, REFUSED_CALL)
        if explain:
            return spark.sql(f"EXPLAIN {explain.group(1) or ''} {wrapped}")
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_folder(spark, "sql"))
        return rows.checkpoint()
    except Exception as problem:  # noqa: BLE001 - the caller gets the text
        return _error(spark, f"Error: {str(problem).splitlines()[0]}")
    finally:
        spark.conf.set(files, before)


def _nodes(spark: SparkSession, plan) -> Iterator[str]:
    """Class names of all nodes of an analysed plan, of their expressions, and of the plans inside these."""
    named = spark._jvm.java.lang.Class.forName
    plans, inner = named("org.apache.spark.sql.catalyst.plans.QueryPlan"), named("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node.getClass().getName()
        parts = [node.children(), node.innerChildren()]
        if plans.isInstance(node):
            parts += [node.expressions(), node.subqueries()]
        elif inner.isInstance(node):
            todo.append(node.plan())
        todo += [found.apply(i) for found in parts for i in range(found.size())]


def _calls_other_code(name: str) -> bool:
    return not name.startswith(_OWN) or bool(_OTHER_CODE.search(name.rsplit(".", 1)[-1]))


def _error(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], StructType([StructField("error", StringType())]))
