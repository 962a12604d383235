"""Read-only SQL over views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Functions that call into the machine that runs them.
UNSAFE_FUNCTIONS = ("reflect", "java_method", "try_reflect")


class NotReadOnly(ValueError):
    """The statement is a command, changes data, runs code or reads a path."""


def _plan(spark: SparkSession, text: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def query(spark: SparkSession, text: str) -> DataFrame:
    """Run one SELECT (with any joins, windows, sets, grouping) over views and tables.

    Judged by the parsed plan, in CTEs and subqueries too: commands, scripts, functions that reach into the JVM and relations
    named by a path (``parquet.`/x```) are refused. Names that merely contain a verb, such as ``updated_ms``, are fine.
    """
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [spark._jvm.java.lang.Class.forName(logical + name) for name in ("Command", "ParsedStatement")]
    a_plan = spark._jvm.java.lang.Class.forName(logical + "LogicalPlan")
    queue = [_plan(spark, text)]
    while queue:
        node = queue.pop()
        name = node.getClass().getSimpleName()
        if a_plan.isInstance(node):
            if any(k.isInstance(node) for k in kinds) or "Script" in name:
                raise NotReadOnly(name)
            if name == "UnresolvedRelation":
                parts = list(_each(node.multipartIdentifier()))
                if len(parts) > 1 and not spark.catalog.databaseExists(".".join(parts[:-1])):
                    raise NotReadOnly(f"no such database: {'.'.join(parts[:-1])}")
            queue += _each(node.expressions())
        elif name == "UnresolvedFunction" and str(list(_each(node.nameParts()))[-1]).lower() in UNSAFE_FUNCTIONS:
            raise NotReadOnly(str(node.nameParts().last()))
        elif hasattr(node, "plan") and "Subquery" in name or name in ("Exists", "ListQuery"):
            queue.append(node.plan())
        queue += [*_each(node.children()), *(x for x in _each(node.innerChildren()) if a_plan.isInstance(x))]
    return spark.sql(text)


def views(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> None:
    """Register Parquet tables of a folder as temporary views."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
