"""Read-only SQL over named views, checked on Spark's own parsed plan."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT, MOST_ROWS, TIMEOUT = 1000, 50_000, 30.0
#: Built-in functions that leave the query: they call the JVM, or tell of files and of the session.
REFUSED = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length "
    "current_catalog current_database current_schema current_user session_user user version spark_partition_id".split()
)
_WRITES = ("CreateTable", "InsertIntoStatement", "DropTable", "UpdateTable", "DeleteFromTable", "MergeIntoTable", "SetCommand", "CacheTable")


class GuardError(ValueError):
    """A statement that isn't a query over the allowed views, or an answer that may not be given."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    elapsed_ms: float
    total: int | None = None
    fingerprint: str | None = None
    point_in_time_safe: bool = False  # a caller's SQL is never known to be


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def check(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Refuse anything but one query over ``views``.

    A name of a common table expression counts only where it is in scope: in the
    query that it belongs to, and in the expressions after it. Functions must be
    built in and not in ``REFUSED``; tables by path and table functions are refused.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise GuardError(f"not a single statement: {error}") from error
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    builtin = jvm.analysis.FunctionRegistry.builtin()

    def function(parts) -> None:
        name = ".".join(_each(parts)).lower()
        if name in REFUSED or "." in name or not builtin.functionExists(jvm.FunctionIdentifier(name)):
            raise GuardError(f"function {name} isn't allowed")

    def expression(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            function(node.nameParts())
        elif kind == "UnresolvedGenerator":
            function(_parts(spark, node.name().unquotedString()))
        for part in _each(node.children()):
            expression(part, scope)

    def walk(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind.endswith("Command") or kind in _WRITES:
            raise GuardError(f"{kind} isn't a query")
        if kind == "UnresolvedWith":
            for entry in _each(node.cteRelations()):
                name = entry._1().lower()
                walk(entry._2(), scope | {name} if node.allowRecursion() else scope)
                scope |= {name}
            walk(node.child(), scope)
            return
        if kind == "UnresolvedRelation" and (name := node.tableName().replace("`", "").lower()) not in scope:
            raise GuardError(f"unknown relation {name}")
        if kind.startswith("UnresolvedTableValued"):
            raise GuardError("table functions aren't allowed")
        for part in _each(node.expressions()):
            expression(part, scope)
        for parts in (node.children(), node.subqueries()):
            for part in _each(parts):
                walk(part, scope)

    walk(plan, frozenset(v.lower() for v in views))


def _parts(spark: SparkSession, name: str):
    return spark._jvm.org.apache.spark.sql.catalyst.analysis.UnresolvedAttribute.parseAttributeName(name)


def guarded(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a checked query."""
    check(spark, sql, set(views))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def answer(
    spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int | None = None, timeout: float | None = TIMEOUT,
    require_complete: bool = False, fingerprint: str | None = None,
) -> Answer:
    """Bounded rows of a checked query.

    One row more than the cap tells whether some are missing; if so, ``total``
    counts them all, and with ``require_complete`` that is an error. A query
    that takes longer than ``timeout`` seconds is cancelled; a file that another
    process rewrites meanwhile is read once more.
    """
    began = time.monotonic()
    cap = min(limit or DEFAULT_LIMIT, MOST_ROWS)
    df = guarded(spark, sql, views)
    context, tag, late = spark.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()
    before = context.getLocalProperty("spark.jobGroup.id")
    timer = None
    if timeout:

        def stop() -> None:
            late.set()
            context.cancelJobGroup(tag)

        timer = threading.Timer(timeout, stop)
        timer.daemon = True
        timer.start()
    context.setJobGroup(tag, "guarded query", interruptOnCancel=True)
    try:
        for attempt in (0, 1):
            try:
                rows = df.limit(cap + 1).collect()
                break
            except PySparkException as error:
                if late.is_set() or attempt or not _is_unreadable(error):
                    raise
                df = guarded(spark, sql, views)
        truncated = len(rows) > cap
        if truncated and require_complete:
            raise GuardError(f"more than {cap} rows")
        total = df.count() if truncated else len(rows)
    except Exception as error:
        if late.is_set():  # however the cancelled job ends
            raise GuardError(f"it took more than {timeout} s") from error
        raise
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
        if timer:
            timer.cancel()
    return Answer(df.columns, [tuple(r) for r in rows[:cap]], truncated, 1000 * (time.monotonic() - began), total, fingerprint)


def _is_unreadable(error: Exception) -> bool:
    return any(x in str(error) for x in ("FAILED_READ_FILE", "FileNotFoundException", "CANNOT_READ_FILE"))
