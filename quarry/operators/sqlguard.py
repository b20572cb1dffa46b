"""Which SQL statements may be run for somebody else.

A statement is judged by the tree that the session's own parser makes of it,
never by its text: every operator must be one that only reads, every function
one of Spark's own from a group that only computes, every relation a table or
view that the session knows.  Common table expressions, subqueries inside
expressions and arguments of functions are parts of the same tree.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

# Class names of the parser's operators that read and compute.
READING = frozenset("""
Aggregate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
OneRowRelation PipeOperator Pivot Project RelationTimeTravel Repartition RepartitionByExpression Sample Sort
SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window
WithWindowDefinition
""".split())
# Groups of Spark's functions that only compute, others that do so
# one by one, and table functions.
COMPUTING_GROUPS = frozenset("""
agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs
generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs
url_funcs variant_funcs window_funcs xml_funcs
""".split())
COMPUTING = frozenset("assert_true bitmap_bit_position bitmap_bucket_number bitmap_count hll_sketch_estimate hll_union "
                      "monotonically_increasing_id raise_error typeof uuid".split())
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack "
                            "variant_explode variant_explode_outer".split())
# Names that stand for something else only when the statement runs.
HIDDEN = frozenset(["ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"])


def _classes(spark: SparkSession) -> dict:
    of = spark._jvm.java.lang.Class.forName
    return {"node": of("org.apache.spark.sql.catalyst.trees.TreeNode"),
            "operator": of("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"),
            "many": of("scala.collection.Iterable"), "option": of("scala.Option"), "product": of("scala.Product")}


def tree_nodes(spark: SparkSession, sql: str):
    """``(node, class name, whether an operator)`` of every node of a statement's
    parsed tree, wherever it is held: as a child, in a list, an option or a pair."""
    kinds = _classes(spark)
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        x = todo.pop()
        if not hasattr(x, "getClass"):  # text, numbers and bytes
            continue
        is_node = kinds["node"].isInstance(x)
        if is_node:
            name = x.getClass().getSimpleName().rstrip("$")
            yield x, name, kinds["operator"].isInstance(x)
            if name == "LocalRelation":  # constants
                continue
        if kinds["many"].isInstance(x) or kinds["option"].isInstance(x):
            inside = x.iterator()
        elif kinds["product"].isInstance(x):
            inside = x.productIterator()
        else:
            continue
        while inside.hasNext():
            todo.append(inside.next())


def _parts(seq) -> list[str]:
    return [seq.apply(k) for k in range(seq.size())]


def _computes(spark: SparkSession, name: str) -> bool:
    """Whether a function is Spark's own, not one registered under its name, and
    only computes."""
    state = spark._jsparkSession.sessionState()
    found = state.functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    if not found.isDefined() or found.get().getSource() != "built-in":
        return False
    return found.get().getGroup() in COMPUTING_GROUPS or name in COMPUTING


def why_refused(spark: SparkSession, sql: str | None, functions: Iterable[str] = ()) -> str | None:
    """None for a statement that only reads, else why it is refused.

    ``functions`` names further functions to let through (the session's own
    UDFs).  A statement that does not parse raises the parser's error.
    """
    if sql is None:
        return "there is no statement"
    extra = {f.lower() for f in functions}
    for node, name, operator in tree_nodes(spark, sql):
        if name in HIDDEN:
            return "names must be written out, not computed"
        if operator and name not in READING:
            return f"only queries are run, no {name}"
        if name == "UnresolvedRelation":
            parts = _parts(node.multipartIdentifier())
            quoted = ".".join("`" + p.replace("`", "``") + "`" for p in parts)
            if len(parts) > 1 and not spark.catalog.tableExists(quoted):
                return f"there is no table {'.'.join(parts)}"
        elif name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = _parts(node.nameParts() if name == "UnresolvedFunction" else node.name())
            called = ".".join(parts).lower()
            known = called in TABLE_FUNCTIONS if name == "UnresolvedTableValuedFunction" else len(parts) == 1 and _computes(spark, called)
            if not known and called not in extra:
                return f"function {called} is not on the list"
    return None
