"""Read-only ad-hoc SQL over named tables, and their catalog."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.operators import filters, metrics, replies

MAX_ROWS = 1000
FORMATS = ("json", "table")

# What a query may be made of. Nodes of the parsed plan, by class name, that only read and combine rows.
_PLANS = frozenset("""
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation Pivot Project Sample Sort SubqueryAlias Union UnionLoop Unpivot UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases
    UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition
""".split())
# Groups of built-in functions that compute from their arguments alone, and harmless ones of other groups.
_FUNCTION_GROUPS = frozenset("""
    agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs datetime_funcs
    generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs
    url_funcs variant_funcs window_funcs xml_funcs
""".split())
_MORE_FUNCTIONS = frozenset(("monotonically_increasing_id", "rand", "randn", "random", "range", "typeof", "uuid"))
# Expressions that stand for a name made up at run time.
_LATE_NAMES = frozenset(("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"))
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)

# The sample queries by group; each takes the messages table.
SAMPLE_QUERIES = {
    "basic": {
        "total_messages": metrics.total_messages,
        "by_source": metrics.by_source,
        "by_sentiment": metrics.by_sentiment,
    },
    "recent": {
        "recent_negative": filters.recent_negative,
        "recent_questions": filters.recent_questions,
    },
    "topics": {
        "topic_distribution": metrics.topic_counts,
        "negative_by_topic": metrics.negative_by_topic,
    },
    "analytics": {
        "sentiment_over_time": metrics.sentiment_daily,
        "unanswered_questions": replies.unanswered_questions,
    },
}


def checked_sql(sql: str, limit: object = MAX_ROWS) -> tuple[str, int]:
    """The cleaned query and the row limit in force."""
    query = sql.strip().rstrip(";").strip()
    if not query:
        raise ValueError("the query is empty")
    if not query.upper().startswith(("SELECT", "WITH")):
        raise ValueError("only SELECT and WITH queries are allowed")
    if ";" in _QUOTED.sub(" ", query):
        raise ValueError("only one statement is allowed")
    try:
        rows = int(limit)  # type: ignore[call-overload]
    except (TypeError, ValueError) as error:
        raise ValueError("limit must be an integer") from error
    return query, max(1, min(rows, MAX_ROWS))


class _Guard:
    """Walks a parsed query, object by object, before any name in it is looked up.

    Plans must be of known kinds, relations must be given tables or names of a WITH in whose scope they stand, functions
    must be built in and of the allowed groups. Whatever a node holds is visited: children, expressions of any clause, and
    the plans of sub-queries in them.
    """

    def __init__(self, session: SparkSession, tables: Mapping[str, DataFrame]):
        jvm = session._jvm
        self._gateway = session.sparkContext._gateway
        self._registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self._identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self._tables = tables

    def _is(self, value: object, kind: str) -> bool:
        return is_instance_of(self._gateway, value, kind)

    def _items(self, sequence: JavaObject) -> Iterator[object]:
        iterator = sequence.iterator()
        while iterator.hasNext():
            yield iterator.next()

    def visit(self, value: object, visible: frozenset[str]) -> None:
        if not isinstance(value, JavaObject):
            return
        if self._is(value, "org.apache.spark.sql.catalyst.trees.TreeNode"):
            self._node(value, visible)
        elif self._is(value, "scala.collection.Iterable") or self._is(value, "scala.Option"):
            for item in self._items(value):
                self.visit(item, visible)
        elif value.getClass().getName().startswith("scala.Tuple"):
            for item in self._items_of(value):
                self.visit(item, visible)

    def _items_of(self, product: JavaObject) -> list[object]:
        return [product.productElement(i) for i in range(product.productArity())]

    def _node(self, node: JavaObject, visible: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind in _LATE_NAMES:
            raise ValueError("names must be written out")
        if self._is(node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan") and kind not in _PLANS:
            raise ValueError(f"only SELECT and WITH queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = [str(part) for part in self._items(node.multipartIdentifier())]
            if len(name) != 1 or name[0].lower() not in visible:
                raise ValueError(f"the query may read {sorted(self._tables)} only, not {'.'.join(name)}")
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            self._function([str(part) for part in self._items(parts)])
        if kind == "UnresolvedWith":
            self._with(node, visible)
            return
        for item in self._items_of(node):
            self.visit(item, visible)

    def _with(self, node: JavaObject, visible: frozenset[str]) -> None:
        """Each relation of a WITH sees those before it, and itself if it may be recursive."""
        for relation in self._items(node.cteRelations()):
            name, *rest = self._items_of(relation)
            own = visible | {str(name).lower()}
            for item in rest:
                self.visit(item, own if node.allowRecursion() else visible)
            visible = own
        self.visit(node.child(), visible)

    def _function(self, name: list[str]) -> None:
        function = name[-1].lower()
        if len(name) == 1 and function in _MORE_FUNCTIONS:
            return
        found = self._registry.lookupFunction(self._identifier(function)) if len(name) == 1 else None
        if found is None or found.isEmpty() or found.get().getGroup() not in _FUNCTION_GROUPS:
            raise ValueError(f"the function {'.'.join(name)} is not allowed")


def _within(rows: DataFrame, session: SparkSession) -> DataFrame:
    """The same analysed query as a frame of another session of the same application."""
    plan = rows._jdf.queryExecution().analyzed()
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def _private_session(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session with the settings of ``spark`` that knows the given views and no other view, function or variable."""
    private = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            private.conf.set(name, value)
    for name, rows in tables.items():
        _within(rows, private).createOrReplaceTempView(name)
    return private


def safe_query(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: object = MAX_ROWS
) -> DataFrame:
    """Result of a checked query over ``tables``, at most ``limit`` rows.

    The query is parsed by itself, so that no text of it can undo the limit. It is analysed in a session of its own that
    holds the tables as views and nothing else; views of the caller's session are neither seen nor changed.
    """
    query, rows = checked_sql(sql, limit)
    return _analysed(spark, query, tables).limit(rows)


def _analysed(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    private = _private_session(spark, tables)
    try:
        parsed = private._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as error:
        raise ValueError(f"the query cannot be parsed: {error}") from error
    _Guard(private, tables).visit(parsed, frozenset(name.lower() for name in tables))
    result = _within(private.sql(query), spark)
    if len(set(result.columns)) < len(result.columns):
        raise ValueError("column names repeat; give each column an alias")
    return result


def run_query(
    spark: SparkSession,
    sql: str,
    tables: Mapping[str, DataFrame],
    limit: object = MAX_ROWS,
    format: str = "json",
) -> dict:
    """Rows of a checked query, at most ``MAX_ROWS`` of them, with what was run and whether there are more."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    query, applied = checked_sql(sql, limit)
    result = _analysed(spark, query, tables)
    rows = result.limit(applied + 1).collect()
    shown = rows[:applied]
    return {
        "columns": result.columns,
        "rows": [row.asDict() if format == "json" else tuple(row) for row in shown],
        "row_count": len(shown),
        "truncated": len(rows) > applied,
        "query": query,
        "requested_query": query,
        "limit_applied": applied,
        "format": format,
    }


def describe_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of each table in order: name, type, nullability."""
    rows = [
        (table, position, field.name, field.dataType.simpleString(), field.nullable)
        for table, frame in tables.items()
        for position, field in enumerate(frame.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string, nullable boolean"
    )


def check_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``describe_tables`` with the row count of each table."""
    counts = None
    for name, rows in tables.items():
        count = rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = count if counts is None else counts.unionByName(count)
    described = describe_tables(spark, tables)
    # One row per table of the catalog.
    return described if counts is None else described.join(F.broadcast(counts), "table_name")
