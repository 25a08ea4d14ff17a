"""Algebra of conditions on columns: conjunctions as intervals, and which of them nothing can meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.store import cut, shuffled


def conjunctions(terms: DataFrame) -> DataFrame:
    """(rule, column, low, high, low_open, high_open, excluded, possible): all terms of a rule on a column as one interval.

    ``terms`` has (rule, column, op, value) with op one of = <> < <= > >=. A bound that no term sets is
    NULL. The values that <> excludes matter only where the interval is one point.
    """
    op, v = F.col("op"), F.col("value")
    low, high = F.when(op.isin(">", ">=", "="), v), F.when(op.isin("<", "<=", "="), v)
    # Of equal bounds the open one is the stricter.
    lows = F.max(F.when(low.isNotNull(), F.struct(low.alias("v"), (op == ">").alias("open"))))
    highs = F.min(F.when(high.isNotNull(), F.struct(high.alias("v"), (op != "<").alias("closed"))))
    each = terms.groupBy("rule", "column").agg(lows.alias("_low"), highs.alias("_high"), F.collect_set(F.when(op == "<>", v)).alias("excluded"))
    flat = each.select("rule", "column", F.col("_low.v").alias("low"), F.col("_high.v").alias("high"), F.coalesce("_low.open", F.lit(False)).alias("low_open"), ~F.coalesce("_high.closed", F.lit(True)), "excluded").toDF("rule", "column", "low", "high", "low_open", "high_open", "excluded")
    point = (F.col("low") == F.col("high")) & ~F.col("low_open") & ~F.col("high_open") & ~F.array_contains("excluded", F.col("low"))
    bounded = F.col("low").isNotNull() & F.col("high").isNotNull()
    return flat.withColumn("possible", ~bounded | (F.col("low") < F.col("high")) | point)


def impossible(terms: DataFrame) -> DataFrame:
    """(rule): rules that no row meets, as the terms on one of their columns contradict each other."""
    return conjunctions(terms).groupBy("rule").agg(F.bool_and("possible").alias("_ok")).where("not _ok").select("rule")


def alternatives(branches: DataFrame) -> DataFrame:
    """(rule, branch): of a disjunction's branches (rule, branch, column, op, value) those that something can meet.

    A rule none of whose branches is left is always false, and has no rows.
    """
    keyed = branches.withColumn("rule", F.struct("rule", "branch"))
    bad = impossible(keyed)
    return keyed.select("rule").distinct().join(shuffled(bad), "rule", "left_anti").select("rule.*")


# --- conditions with AND, OR and NOT -------------------------------------------------------------

_INVERSE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def _by(op: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), op)


def without_not(nodes: DataFrame) -> DataFrame:
    """(rule, node, parent, level, kind, column, op, value) of expression trees without NOT.

    ``nodes`` has (rule, node, parent, kind, column, op, value): kind is and, or, not or term, the root's
    parent is NULL, and a term's column, op and value are those of conjunctions(). Going down a level at a time,
    a node below an odd number of NOT becomes its opposite; a NOT is an AND of one.
    """
    opposite = F.col("_odd")
    children = nodes.select("rule", "node", F.col("parent").alias("_up"), "parent", "kind", "column", "op", "value")
    now = nodes.where("parent is null").select(*nodes.columns, F.lit(False).alias("_odd"), F.lit(0).alias("level"))
    out, level = now, 0
    while not now.isEmpty():
        above = now.select("rule", F.col("node").alias("_up"), (F.col("_odd") != (F.col("kind") == "not")).alias("_odd"))
        level += 1
        now = cut(children.join(shuffled(above), ["rule", "_up"]).select(*nodes.columns, "_odd", F.lit(level).alias("level")))
        out = out.unionByName(now)
    kind = F.when(F.col("kind") == "not", "and").when(opposite & (F.col("kind") == "and"), "or").when(opposite & (F.col("kind") == "or"), "and").otherwise(F.col("kind"))
    op = F.when(opposite, _by(F.col("op"), _INVERSE)).otherwise(F.col("op"))
    return out.select("rule", "node", "parent", "level", kind.alias("kind"), "column", op.alias("op"), "value")


def branches_of(nodes: DataFrame) -> DataFrame:
    """(rule, branch, column, op, value): the terms of each conjunction of a rule's disjunctive normal form.

    From the deepest level up, a node's branches are grouped into its parent: those of an OR are put
    together, those of an AND are combined each with each. A rule's branches are as many as its
    normal form has. An AND of nothing holds always and has one branch without terms, whose column is NULL.
    """
    flat = cut(without_not(nodes))
    term = F.struct(F.col("column").alias("column"), F.col("op").alias("op"), F.col("value").cast("double").alias("value"))
    none = "array<array<struct<column:string,op:string,value:double>>>"
    own = F.when(F.col("kind") == "term", F.array(F.array(term)))
    deepest = flat.agg(F.max("level")).first()[0] or 0
    each = lambda acc, b: F.flatten(F.transform(acc, lambda x: F.transform(b, lambda y: F.concat(x, y))))
    below = None
    for level in range(deepest, -1, -1):
        here = flat.where(F.col("level") == level).withColumn("_own", own)
        if below is None:
            here = here.withColumn("_all", F.lit(None).cast(f"array<{none}>"))
        else:
            here = here.join(shuffled(below), ["rule", "node"], "left")
        made = F.when(F.col("kind") == "term", F.col("_own")).when(F.col("kind") == "or", F.flatten(F.coalesce("_all", F.array().cast(f"array<{none}>"))))
        made = made.otherwise(F.aggregate(F.coalesce("_all", F.array().cast(f"array<{none}>")), F.array(F.array()).cast(none), each))
        done = here.select("rule", "parent", "node", F.array_distinct(made).alias("_made"))
        below = done.groupBy("rule", F.col("parent").alias("node")).agg(F.collect_list("_made").alias("_all"))
    return done.select("rule", F.posexplode("_made").alias("branch", "_terms")).select("rule", "branch", F.explode_outer("_terms").alias("t")).select("rule", "branch", "t.*")


def value_sets(nodes: DataFrame) -> DataFrame:
    """(rule, column, place, low, high, low_open, high_open): the values of each column for which some values of the others meet the rule.

    Intervals are disjoint and in order; a bound that is missing is NULL. A rule that nothing meets has
    no rows; a column that may take any value has one interval without bounds.

    Each branch that something can meet gives its interval on each of the rule's columns (any value
    on a column that it does not name), cut at the values that <> takes out. A sweep over the ends
    of all intervals of (rule, column) then joins those that meet.
    """
    all_branches = cut(branches_of(nodes))
    columns = nodes.where("column is not null").select("rule", "column").distinct()
    each = conjunctions(all_branches.where("column is not null").withColumn("rule", F.struct("rule", "branch"))).select("rule.*", "column", "low", "high", "low_open", "high_open", "excluded", "possible")
    bad = each.where("not possible").select("rule", "branch").distinct()
    good = all_branches.select("rule", "branch").distinct().join(shuffled(bad), ["rule", "branch"], "left_anti")
    on = good.join(shuffled(columns), "rule").join(shuffled(each.drop("possible")), ["rule", "branch", "column"], "left")
    inf = float("inf")
    low, high = F.coalesce("low", F.lit(-inf)), F.coalesce("high", F.lit(inf))
    # An end is a value and a shade: an open low end stands a shade above its value, an open high one a shade below.
    end = lambda v, shade: F.struct(v.alias("v"), shade.cast("int").alias("s"))
    inner = F.array_sort(F.filter(F.coalesce("excluded", F.array().cast("array<double>")), lambda v: (v >= low) & (v <= high)))
    begins = F.concat(F.array(end(low, F.coalesce("low_open", F.lit(False)))), F.transform(inner, lambda v: end(v, F.lit(1))))
    stops = F.concat(F.transform(inner, lambda v: end(v, F.lit(-1))), F.array(end(high, -F.coalesce("high_open", F.lit(False)).cast("int"))))
    pieces = on.select("rule", "column", F.explode(F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))).alias("p"))
    pieces = pieces.select("rule", "column", "p.start", "p.stop").where("start <= stop")
    order = Window.partitionBy("rule", "column").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = reach.isNull() | (F.col("start") > end(reach["v"], reach["s"] + 1))
    islands = pieces.withColumn("_new", apart.cast("int")).withColumn("place", F.sum("_new").over(order)).groupBy("rule", "column", "place").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    bounded = lambda v: F.when(F.abs(v) < inf, v)
    return islands.select("rule", "column", F.col("place").cast("int").alias("place"), bounded(F.col("a.v")).alias("low"), bounded(F.col("b.v")).alias("high"), (F.col("a.s") == 1).alias("low_open"), (F.col("b.s") == -1).alias("high_open"))
