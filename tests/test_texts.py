import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import advisor as A
from tidewatch.operators import results as R
from tidewatch.operators import rewrite as W
from tidewatch.operators import sqltext as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hash(spark):
    assert one(spark, Q.dek_hash(F.lit("abcdefg000\n abc"))) == 1663651373
    assert one(spark, Q.dek_hash(F.lit(""))) == 0


def test_templates(spark):
    assert one(spark, Q.templatise(F.lit("insert into t values (1, 'a') -- x"))) == "INSERT INTO T VALUES"
    assert one(spark, Q.templatise(F.lit("select a\n from t where b>=1.5 and c='x'"))) == "SELECT A FROM T WHERE B >= ? AND C = ?"


def test_durations(spark):
    assert one(spark, Q.duration_seconds(F.lit("1d2h3m4s"))) == 93784
    assert one(spark, Q.duration_seconds(F.lit("15s"))) == 15


def test_parameters(spark):
    values = F.array(*(F.lit(f"v{i}") for i in range(1, 12)))
    assert one(spark, Q.fill_parameters(F.lit("a $1 b $11"), values)) == "a v1 b v11"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select a from t where 1 = 1 and b > 2", "select a from t WHERE b > 2"),
        ("select a from t where b = 1 or b = 2 or b = 3", "select a from t where b IN (1, 2, 3)"),
        ("select a from t where b + 3 < 10", "select a from t where b < 10 - 3"),
        ("select a from t where b * -2 < 10", "select a from t where b > 10 / (-2)"),
        ("select a, b from t order by 2 desc, 1", "select a, b from t order by b desc, a"),
        ("select a from t where b = 3 order by b, a", "select a from t where b = 3 order by a"),
        ("delete from t", "TRUNCATE TABLE t"),
        ("select a from t where b > 2", "select a from t where b > 2"),
    ],
)
def test_rewrites(spark, sql, want):
    changed, got = W.rewrite(spark, sql)
    assert " ".join(got.split()).lower() == want.lower() and changed == (sql != want)


def test_probes(spark):
    p = W.probes(spark, "select a from t join u on t.x = u.x where lower(b) = 'c' and d in (1, 2, 3)")
    assert p["valid"] and p["tables"] == ["t", "u"] and p["joins"] == 1 and p["in_list"] == 3 and p["function_in_filter"]
    assert not W.probes(spark, "selec a")["valid"]


def test_band_join_equals_nested_loop(spark):
    rng = random.Random(5)
    a, b = [rng.randint(0, 60) for _ in range(50)], [rng.randint(-5, 70) for _ in range(50)]
    got = R.band_join(spark.createDataFrame([(x,) for x in a], "a long"), spark.createDataFrame([(x,) for x in b], "b long"), "a", "b", 7)
    assert sorted(map(tuple, got.select("a", "b").collect())) == sorted((x, y) for x in a for y in b if x <= y <= x + 7)


def test_tree_search_fits_the_room():
    worth, size = {1: 6.0, 2: 5.0, 3: 4.0}, {1: 3.0, 2: 2.0, 3: 2.0}
    assert A.tree_search(lambda s: sum(worth[i] for i in s), [1, 2, 3], size, 4.0) == ([2, 3], 9.0)


def best_worth(worth, room):
    best = [0.0] * (room + 1)
    for size, w in worth.items():
        for left in range(room, size - 1, -1):
            best[left] = max(best[left], best[left - size] + w)
    return best[room]


def test_tree_search_equals_exact_knapsack():
    rng = random.Random(8)
    for _ in range(10):
        worth = {i: rng.uniform(1, 100) * rng.choice([1, i]) for i in range(1, 51)}
        chosen, value = A.tree_search(lambda s: sum(worth[i] for i in s), sorted(worth), {i: float(i) for i in worth}, 20.0, rounds=1000)
        assert sum(chosen) <= 20 and abs(value - best_worth(worth, 20)) < 1e-6


@pytest.mark.parametrize("heavy", [5, 13, 17, 20])
def test_tree_search_query_takes_any_size_that_fits(spark, tmp_path, heavy):
    worth = {i: 100.0 + i % 7 for i in range(1, 51)} | {heavy: 5000.0, 21: 90_000.0}
    spark.createDataFrame(list(worth.items()), "p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = entry.queries()["i08_tree_search"](spark, str(tmp_path)).collect()
    assert heavy in {r["index_id"] for r in rows} and sum(r["index_id"] for r in rows) <= 20
    assert abs(rows[0]["benefit"] - best_worth(worth, 20)) < 1e-6


def test_ancestors_follow_chains_of_any_length_and_refuse_cycles(spark):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(101)] + [(500, 499)], "a long, b long")
    got = {r["a"]: (r["root"], r["depth"]) for r in R.ancestors(links, "a", "b").collect()}
    assert got == {i: (0, i) for i in range(101)} | {500: (499, 1)}
    for ring in ([(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            R.ancestors(spark.createDataFrame(ring, "a long, b long"), "a", "b")


def test_greedy_takes_what_fits_behind_many_that_do_not(spark):
    cost = spark.createDataFrame([(1, 0, 1000.0, 1)] + [(1, c, float(c), 1) for c in range(1, 152)], "query_id long, config_id long, cost double, freq long")
    assert A.greedy(cost, 2, {c: 9.0 if c <= 150 else 1.0 for c in range(1, 152)}, 2.0) == [151]
