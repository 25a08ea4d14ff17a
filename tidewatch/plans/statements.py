"""Queries of statement tokens, statement trees and conditions with AND, OR and NOT."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import predicates as P
from tidewatch.operators import tokens as T
from tidewatch.plans.registry import query
from tidewatch.sources.series import table

#: Statements of orders with what their tokens show, by o_orderkey % 10: text, tables, columns, functions, calls, IN lists, longest list, subqueries, height, joins, marks, normalised.
#: Texts hold words in strings and comments, commas inside calls, brackets in strings and subqueries in subqueries; x is the customer.
_SHAPES = (
    ("'select a, b from t' || x || ' where a = 1 and lower(b) = \"from u where\"'", "'t' || x", "'a'", "'lower'", 1, 0, 0, 0, 0, 0, "''", False),
    ("'select a from t where b = @it@@s from u, v (where@ and c in (1, 2, ' || x || ')'", "'t'", "'b,c'", "''", 0, 1, 3, 0, 0, 0, "''", False),
    ("'select f(a, b), g(c) from t, u join v on t.x = v.x where t.y > $1 and abs(coalesce(t.z, u.z)) < $2'", "'t,u,v'", "'t.y'", "'abs,coalesce'", 2, 0, 0, 0, 0, 1, "'$1,$2'", True),
    ("'select a from (select b from t' || x || ' where b in (select c from u where d = ?)) s where a > ?'", "'t' || x || ',u'", "'a'", "''", 0, 0, 0, 2, 2, 0, "'?'", True),
    ("'update t' || x || ' set a = 1, b = (select max(c) from u) where d between 2 and 3 -- from w'", "'t' || x || ',u'", "'d'", "''", 0, 0, 0, 1, 1, 0, "''", False),
    ("'insert into t (a, b) values (' || x || ', @;@), (2, @)@)'", "'t'", "''", "''", 0, 0, 0, 0, 0, 0, "''", False),
    ("'select count(*) from s.t' || x || ' as q left join u on q.a = u.a right join v on v.b = u.b /* where x in (1, 2) */ where q.c is not null'", "'s.t' || x || ',u,v'", "'q.c'", "''", 0, 0, 0, 0, 0, 2, "''", False),
    ("'delete from t where a not in (1, f(2, 3), ' || x || ', 4) or b in (@a,b@, @c@)'", "'t'", "'a,b'", "'f'", 1, 2, 4, 0, 0, 0, "''", False),
    ("'select a from t' || x || ' where exists (select 1 from u where u.a = t' || x || '.a and exists (select 2 from v where upper(v.b) = u.b))'", "'t' || x || ',u,v'", "''", "'upper'", 1, 0, 0, 2, 2, 0, "''", False),
    ("'select a from t where ((b = 1 or (c = 2)) and not d like @%x@) order by trunc(a), b limit 5'", "'t'", "'b,c,d'", "''", 0, 0, 0, 0, 0, 0, "''", False),
)


def _texts(spark, d):
    text = "CASE k % 10 " + " ".join(f"WHEN {i} THEN {s[0]}" for i, s in enumerate(_SHAPES)) + " END"
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS x").selectExpr("k AS id", "k", "x", f"replace({text}, '@', chr(39)) AS sql")


def _shape(place: int) -> str:
    return "CASE k % 10 " + " ".join(f"WHEN {i} THEN {s[place]}" for i, s in enumerate(_SHAPES)) + " END"


_PROBED = ("tables", "columns", "functions", "calls", "in_lists", "longest_list", "subqueries", "height", "joins", "marks", "normalised")


@query("c15_token_probes", f"SELECT k AS id, {', '.join(f'{_shape(i + 1)} AS {n}' for i, n in enumerate(_PROBED))} FROM (SELECT o_orderkey AS k, o_custkey AS x FROM orders)")
def c15(spark, d):
    """Tables, columns, functions, lists, subqueries and placeholders, from tokens with their depth and clause."""
    found = T.probes(_texts(spark, d), "id", "sql")
    joined = {n: F.array_join(n, ",") for n in ("tables", "columns", "functions", "marks")}
    return found.select("id", *(joined.get(n, F.col(n)).alias(n) for n in _PROBED))


#: Statements of orders as they come and as they are standardised, by o_orderkey % 5.
_LOOSE = (
    ("'select  A , t.B' || chr(10) || ' from T' || x || ' t where a>=1 and B=@It@@s, Mine@ -- where C'", "'SELECT a, t.b FROM t' || x || ' t WHERE a >= 1 AND b = @It@@s, Mine@'"),
    ("'update t set a=a+1,b = Lower( C ) where d in(' || x || ',2)'", "'UPDATE t SET a = a + 1, b = lower(c) WHERE d IN (' || x || ', 2)'"),
    ("'insert into T values(' || x || ',@a ; b@) ;'", "'INSERT INTO t VALUES (' || x || ', @a ; b@);'"),
    ("'select count( * ) from \"My Table\" /* by ' || x || ' */ order by 1 desc'", "'SELECT count(*) FROM \"My Table\" ORDER BY 1 DESC'"),
    ("'delete   from t where exists(select 1 from U where U.a<>' || x || ')'", "'DELETE FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.a <> ' || x || ')'"),
)
#: Statements of orders with placeholders, and with these numbered, by o_orderkey % 4, and how many there are.
_MARKED = (
    ("'select a from t' || x || ' where b = ? and c = @?@ and d in (?,  ?)'", "'select a from t' || x || ' where b = $1 and c = @?@ and d in ($2,  $3)'", 3),
    ("'select ' || x || ' from t where a = @x@ -- ?' || chr(10) || ' and b > ? ;'", "'select ' || x || ' from t where a = @x@ -- ?' || chr(10) || ' and b > $1 ;'", 1),
    ("'delete from t' || x", "'delete from t' || x", 0),
    ("'update \"t?\" set a=?,b=? /* ? */ where c in (' || x || ')'", "'update \"t?\" set a=$1,b=$2 /* ? */ where c in (' || x || ')'", 2),
)


def _of(shapes, place: int) -> str:
    return f"replace(CASE k % {len(shapes)} " + " ".join(f"WHEN {i} THEN {s[place]}" for i, s in enumerate(shapes)) + " END, '@', chr(39))"


@query("c16_standardised", f"SELECT k AS id, {_of(_LOOSE, 1)} AS standard FROM (SELECT o_orderkey AS k, o_custkey AS x FROM orders)")
def c16(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS x").selectExpr("k AS id", f"{_of(_LOOSE, 0)} AS sql")
    return T.standardised(o, "id", "sql")


@query("c17_prepared", f"""SELECT k AS id, numbered, marks, 'prepare p' || k || ' as ' || rtrim(numbered, ' ;') || '|explain execute p' || k || CASE marks WHEN 0 THEN '' WHEN 1 THEN '(NULL)' WHEN 2 THEN '(NULL,NULL)' ELSE '(NULL,NULL,NULL)' END || '|deallocate prepare p' || k AS statements
 FROM (SELECT k, {_of(_MARKED, 1)} AS numbered, CASE k % 4 {' '.join(f'WHEN {i} THEN {n}' for i, (_, _, n) in enumerate(_MARKED))} END AS marks FROM (SELECT o_orderkey AS k, o_custkey AS x FROM orders))""")
def c17(spark, d):
    """Placeholders as numbers, but not those in texts, names and comments, and the statements that explain such a one."""
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS x").selectExpr("k AS id", f"{_of(_MARKED, 0)} AS sql")
    made = T.prepared(o, "id", "sql", F.concat(F.lit("p"), F.col("id").cast("string")))
    return T.numbered(o, "id", "sql").join(made, "id").select("id", "numbered", "marks", F.array_join("statements", "|").alias("statements"))


#: Pairs of statements of each part by p_partkey % 6, with the levels of the nodes that both have: clauses of the statement (0) and what stands in them (1), of a subquery (2, 3).
_PAIRS = (
    ("'select a, b from t where c = ' || p_size", "'select a, b from t where c = ' || p_size", {0: 3, 1: 4}),
    ("'select a, b from t where c = 1'", "'select b, d from t where c = 2'", {0: 3, 1: 2}),
    ("'select a from t where b in (select c from u where d = 1) and e between 1 and 2'", "'select a from t where b in (select c from v where d = 1) or e between 1 and 2'", {0: 3, 1: 4, 2: 3, 3: 2}),
    ("'select a from t order by a, b'", "'update t set a = ' || p_size", {}),
    ("'select a, a, b from t' || p_size", "'select a from t' || p_size", {0: 2, 1: 3}),
    ("'select a from (select b from t group by b) x'", "'select a from (select b from t group by c) x'", {0: 2, 1: 2, 2: 3, 3: 2}),
)


@query("c22_tree_similarity", f"SELECT p_partkey, round(CASE p_partkey % 6 {' '.join(f'WHEN {i} THEN {sum(n * T.FADES**level for level, n in same.items())!r}' for i, (_, _, same) in enumerate(_PAIRS))} END, 6) AS similarity FROM part")
def c22_tree(spark, d):
    """How alike two statements' trees are, nodes near the root counting most."""
    side = lambda k: "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {p[k]}" for i, p in enumerate(_PAIRS)) + " END"
    pairs = table(spark, d, "part").selectExpr("p_partkey", f"{side(0)} AS a", f"{side(1)} AS b")
    texts = pairs.select(F.col("a").alias("text")).union(pairs.select("b")).distinct()
    nodes = T.tree_nodes(texts.withColumn("sql", F.col("text")), "text", "sql")
    return T.tree_similarity(pairs, "a", "b", nodes, "text").select("p_partkey", F.round("similarity", 6).alias("similarity"))


#: Conditions on a and b of each order by o_orderkey % 6, as SQL and as trees: x, y, z, w are whole numbers below ten.
_NUMBERS = "o_orderkey % 10 AS x, o_custkey % 10 AS y, o_orderkey * 7 // 10 % 10 AS z, o_custkey * 3 // 10 % 10 AS w"
_CONDITIONS = (
    ("(a > x AND b < y) OR NOT (a <= z OR b = w)", ("or", ("and", "a > x", "b < y"), ("not", ("or", "a <= z", "b = w")))),
    ("NOT (a > x AND a < y) AND (b >= z OR a = w)", ("and", ("not", ("and", "a > x", "a < y")), ("or", "b >= z", "a = w"))),
    ("(a < x OR a >= y) AND a <> z", ("and", ("or", "a < x", "a >= y"), "a <> z")),
    ("a > x AND a < y AND b = z", ("and", "a > x", "a < y", "b = z")),
    ("NOT (a = x OR NOT (b < y AND a <= z))", ("not", ("or", "a = x", ("not", ("and", "b < y", "a <= z"))))),
    ("(a = x OR a > y) AND (b = z OR b <> w) OR NOT NOT a < w", ("or", ("and", ("or", "a = x", "a > y"), ("or", "b = z", "b <> w")), ("not", ("not", "a < w")))),
)


def _rows_of(tree, parent=None, out=None):
    """(node, parent, kind, column, op, name of the value) of a tree."""
    out = [] if out is None else out
    node = len(out)
    if isinstance(tree, str):
        column, op, name = tree.split()
        out.append((node, parent, "term", column, op, name))
    else:
        out.append((node, parent, tree[0], None, None, None))
        for child in tree[1:]:
            _rows_of(child, node, out)
    return out


@query("u09_value_sets", f"""WITH o AS (SELECT o_orderkey AS rule, o_orderkey % 6 AS shape, {_NUMBERS} FROM orders), g AS (SELECT i / 2.0 AS v FROM range(-2, 22) r(i)),
 e AS (SELECT rule, shape, a, b, CASE shape {' '.join(f'WHEN {i} THEN {c}' for i, (c, _) in enumerate(_CONDITIONS))} END AS met FROM (SELECT o.*, g.v AS a, h.v AS b FROM o, g, g h)),
 n AS (SELECT o.rule, c.name FROM o, (VALUES ('a'), ('b')) c(name) WHERE c.name = 'a' OR shape <> 2),
 m AS (SELECT DISTINCT rule, 'a' AS "column", a AS v FROM e WHERE met UNION SELECT DISTINCT rule, 'b', b FROM e WHERE met),
 i AS (SELECT m.*, v * 2 - row_number() OVER (PARTITION BY m.rule, "column" ORDER BY v) AS grp FROM m JOIN n ON m.rule = n.rule AND m."column" = n.name),
 s AS (SELECT rule, "column", grp, min(v) AS f, max(v) AS l FROM i GROUP BY rule, "column", grp)
 SELECT rule, "column", CAST(row_number() OVER (PARTITION BY rule, "column" ORDER BY f) AS INT) AS place, CASE WHEN f > -1 THEN floor(f) + 0.0 END AS low, CASE WHEN l < 10.5 THEN ceil(l) + 0.0 END AS high, f > -1 AND f <> floor(f) AS low_open, l < 10.5 AND l <> floor(l) AS high_open FROM s""")
def u09_sets(spark, d):
    """Which values of a and of b each order's condition leaves, as disjoint intervals; the SQL tries all whole numbers and what lies between them."""
    o = table(spark, d, "orders").selectExpr("o_orderkey AS rule", "o_orderkey % 6 AS shape", *_NUMBERS.replace("* 7 //", "* 7 div").replace("* 3 //", "* 3 div").split(", "))
    value = {n: F.col(n).cast("double") for n in "xyzw"}
    node = lambda r: F.struct(F.lit(r[0]).alias("node"), F.lit(r[1]).cast("int").alias("parent"), F.lit(r[2]).alias("kind"), F.lit(r[3]).cast("string").alias("column"), F.lit(r[4]).cast("string").alias("op"), value.get(r[5], F.lit(None).cast("double")).alias("value"))
    trees = F.coalesce(*(F.when(F.col("shape") == i, F.array(*(node(r) for r in _rows_of(t)))) for i, (_, t) in enumerate(_CONDITIONS)))
    return P.value_sets(o.select("rule", F.explode(trees).alias("n")).select("rule", "n.*"))
