"""Tokens, trees and conditions of statements."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import predicates as P
from tidewatch.operators import tokens as T


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, sql string")


def test_tokens_know_their_depth_and_clause(spark):
    sql = "select f(a, (b)) from t where x in (select y from u where z = ')') and c = 1"
    rows = T.in_clause(T.tokens(frame(spark, [sql]), "id", "sql"), "id").orderBy("pos").collect()
    assert " ".join(r["token"] for r in rows) == "select f ( a , ( b ) ) from t where x in ( select y from u where z = ')' ) and c = 1"
    by = {r["token"]: r for r in rows}
    assert by["b"]["depth"] == 2 and by["y"]["depth"] == 1 and by["c"]["depth"] == 0
    assert (by["y"]["nest"], by["y"]["part"], by["u"]["part"], by["z"]["part"]) == (1, "SELECT", "FROM", "WHERE")
    assert (by["a"]["caller"], by["a"]["called"], by["y"]["caller"], by["y"]["called"]) == ("F", True, "IN", False)
    assert (by["c"]["part"], by["c"]["query"], by["')'"]["kind"]) == ("WHERE", -1, "text")


def test_odd_texts_have_what_tokens_they_have(spark):
    texts = [None, "", "  \n", "-- only this", "select", ")))((", "select 'open", "/* a */ select /* b */ 1", "é = ß and \"q r\" <> $12"]
    got = T.tokens(frame(spark, texts), "id", "sql").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "|").alias("t"))
    assert {r["id"]: r["t"] for r in got.collect()} == {4: "select", 5: ")|)|)|(|(", 6: "select|'|open", 7: "select|1", 8: "é|=|ß|and|\"q r\"|<>|$12"}
    found = {r["id"]: r for r in T.probes(frame(spark, texts), "id", "sql").collect()}
    assert set(found) == {4, 5, 6, 7, 8} and found[8]["marks"] == ["$12"] and found[8]["normalised"] and not found[7]["normalised"]


def test_long_lists_are_counted(spark):
    sql = "select a from t where a in (" + ", ".join(map(str, range(5000))) + ")"
    assert T.probes(frame(spark, [sql]), "id", "sql").first()["longest_list"] == 5000


def similarity(spark, a, b, literals=True):
    nodes = T.tree_nodes(frame(spark, [a, b]), "id", "sql", literals)
    return T.tree_similarity(spark.createDataFrame([(0, 1)], "a int, b int"), "a", "b", nodes, "id").first()["similarity"]


def test_trees_of_equal_shape(spark):
    a, b = "select a from t where b = 1 and c in (select d from u where e = 'x')", "select a from t where b = 2 and c in (select d from u where e = 'y')"
    whole = 3 + 4 * 0.8 + 3 * 0.8**2 + 3 * 0.8**3  # three clauses and four items; below, three clauses and three items
    assert similarity(spark, a, a) == pytest.approx(whole)
    assert similarity(spark, a, b) == pytest.approx(whole - 0.8 - 0.8**3)
    assert similarity(spark, a, b, literals=False) == pytest.approx(whole)
    assert similarity(spark, a, "") == 0
    # What stands in a subquery is not the same at the top.
    assert similarity(spark, "select d from u", "select a from (select d from u) x") == pytest.approx(2)


# --- conditions ----------------------------------------------------------------------------------


def rows_of(tree, rule, parent=None, out=None):
    out = [] if out is None else out
    node = len(out)
    if tree[0] == "term":
        out.append((rule, node, parent, "term", *tree[1:]))
    else:
        out.append((rule, node, parent, tree[0], None, None, None))
        for child in tree[1:]:
            rows_of(child, rule, node, out)
    return out


def holds(tree, row):
    kind, *rest = tree
    if kind == "term":
        c, op, v = rest
        x = row[c]
        return {"=": x == v, "<>": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]
    values = [holds(t, row) for t in rest]
    return not values[0] if kind == "not" else all(values) if kind == "and" else any(values)


def drawn(rng, depth=0):
    if depth == 3 or rng.random() < 0.35:
        return "term", rng.choice("abc"), rng.choice(["=", "<>", "<", "<=", ">", ">="]), float(rng.randint(0, 3))
    kind = rng.choice(["and", "or", "not"])
    return (kind, *(drawn(rng, depth + 1) for _ in range(1 if kind == "not" else rng.randint(1, 3))))


SCHEMA = "rule int, node int, parent int, kind string, column string, op string, value double"


def test_value_sets_equal_all_values_tried(spark):
    rng = random.Random(4)
    trees = [drawn(rng) for _ in range(60)]
    trees += [("and", ("term", "a", ">", 3.0), ("term", "a", "<", 3.0)), ("or", ("term", "a", "<", 3.0), ("term", "a", ">=", 3.0)), ("or", ("term", "a", "<", 3.0), ("term", "a", ">", 3.0)), ("not", ("not", ("term", "b", "<>", 1.0))), ("and",), ("or",)]
    nodes = spark.createDataFrame([r for k, t in enumerate(trees) for r in rows_of(t, k)], SCHEMA)
    got = {}
    for r in P.value_sets(nodes).collect():
        got.setdefault((r["rule"], r["column"]), []).append(r)
    grid = [k / 2 for k in range(-1, 8)]  # all whole numbers that occur and what lies around them
    for k, tree in enumerate(trees):
        columns = sorted({r[4] for r in rows_of(tree, k) if r[4]})
        met = [dict(zip(columns, p)) for p in itertools.product(grid, repeat=len(columns))]
        met = [m for m in met if holds(tree, m)]
        for c in columns:
            mine = sorted(got.get((k, c), []), key=lambda r: r["place"])
            inside = lambda x: sum((r["low"] is None or x > r["low"] or (x == r["low"] and not r["low_open"])) and (r["high"] is None or x < r["high"] or (x == r["high"] and not r["high_open"])) for r in mine)  # noqa: E731, B023
            assert {x for x in grid if inside(x)} == {m[c] for m in met}, (k, c)
            assert all(inside(x) <= 1 for x in grid)  # disjoint, and no two that touch
            assert all(a["high"] < b["low"] or (a["high"] == b["low"] and a["high_open"] and b["low_open"]) for a, b in itertools.pairwise(mine))
    full = [(r["low"], r["high"]) for r in got[(len(trees) - 5, "a")]]
    assert full == [(None, None)] and (len(trees) - 6, "a") not in got


def test_branches_of_a_product(spark):
    tree = ("and", ("or", ("term", "a", "=", 1.0), ("term", "a", "=", 2.0)), ("not", ("and", ("term", "b", "<", 3.0), ("term", "c", "<", 4.0))))
    rows = P.branches_of(spark.createDataFrame(rows_of(tree, 0), SCHEMA)).collect()
    branches = {}
    for r in rows:
        branches.setdefault(r["branch"], set()).add((r["column"], r["op"], r["value"]))
    assert sorted(map(sorted, branches.values())) == sorted(sorted([("a", "=", x), y]) for x in (1.0, 2.0) for y in (("b", ">=", 3.0), ("c", ">=", 4.0)))


def test_no_conditions(spark):
    assert P.value_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conditions_are_never_broadcast(spark):
    """Nodes and branches come from an explode, which Spark sizes as the rows before it."""
    tree = ("or", ("term", "a", ">", 1.0), ("not", ("and", ("term", "a", "<", 5.0), ("term", "b", "=", 2.0))))
    sets = P.value_sets(spark.createDataFrame(rows_of(tree, 0), SCHEMA))
    assert sets.collect()
    assert "Broadcast" not in sets._jdf.queryExecution().executedPlan().toString()
