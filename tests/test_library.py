"""Goldens and brute force for operators whose queries SQL cannot express, and cases that their tables do not have."""

import itertools
import math
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import kept
from tidewatch.functions import numerics as N
from tidewatch.operators import advisor as A
from tidewatch.operators import arima, causes, conditions, recurrence, similarity
from tidewatch.operators import detectors as D
from tidewatch.operators import predicates as P
from tidewatch.operators import results as R
from tidewatch.operators import rewrite as W

from tidewatch.operators import sqltext as Q
from tidewatch.operators import statistics as K
from tidewatch.sources import store
from tidewatch.streaming import alarms as L


def series(spark, values, name="a", step=1):
    return spark.createDataFrame([(name, i * step, float(v)) for i, v in enumerate(values)], "name string, ts_ms long, value double")


# --- numbers -------------------------------------------------------------------------------------


def cox_stuart(values, side, alpha):
    """The rule in plain words: twice the binomial distribution, its first rise, counts of pairs at half the length."""
    n, half = len(values), len(values) // 2
    up = sum(values[i + half] > values[i] for i in range(half))
    down = sum(values[i + half] < values[i] for i in range(half))
    against = down if side == "positive" else up
    if against > half - against and against > (up if side == "positive" else down):
        return False
    cdf = lambda k, m: sum(math.comb(m, i) for i in range(k + 1)) / 2**m
    if alpha is None:
        table = [2 * cdf(k, n) for k in range(half + 1)]
        alpha = next(a for a, b in zip(table, table[1:]) if b - a > 1e-5)
        p = table[against]
    else:
        p = 2 * cdf(against, up + down)
    slope = np.polyfit(range(n), values, 1)[0]
    return bool(p < alpha and (slope > 0 if side == "positive" else slope < 0))


def test_cox_stuart():
    rng = random.Random(1)
    for _ in range(400):
        n, lift = rng.randint(2, 40), rng.choice([0, 0.05, 0.5, -0.5])
        values = np.array([rng.random() + lift * i for i in range(n)])
        for side, alpha in itertools.product(("positive", "negative"), (None, 0.05)):
            assert N.cox_stuart(values, side, alpha) == cox_stuart(values.tolist(), side, alpha)
    assert not N.cox_stuart(np.array([1.0])) and not N.cox_stuart(np.array([]))


def test_increase_of_a_noisy_line(spark):
    rng = random.Random(0)
    up = [0.05 * i + 0.7 * rng.randint(1, 5) for i in range(50)]
    assert all(r["is_anomaly"] for r in D.increase(series(spark, up), ["name"]).collect())
    assert all(r["is_anomaly"] for r in D.increase(series(spark, [-v for v in up]), ["name"], "negative", 0.05).collect())


def test_holt_winters_golden(spark):
    got = N.holt_winters(np.array([10 + math.sin(i) for i in range(60)]), period=24)
    assert np.allclose(got[:4], [-6.4, -10.7, -14.3, -17.0], atol=0.06)
    with pytest.raises(ValueError):
        K.residuals(series(spark, [1, 2]), ["name"], "other")


def test_augmented_dickey_fuller():
    rng = np.random.default_rng(0)
    noise = rng.standard_normal(500)
    walk = np.cumsum(noise)
    assert N.adf_p_value(N.adf(noise)[0]) < 0.01 < 0.05 < N.adf_p_value(N.adf(walk)[0])
    assert N.adf_p_value(-2.86154) == pytest.approx(0.05, abs=0.002) and N.adf_p_value(-3.43035) == pytest.approx(0.01, abs=0.001)
    assert N.adf_critical(10**9) == pytest.approx(-2.86154) and N.adf_critical(100) == pytest.approx(-2.8909, abs=1e-3)
    assert N.adf_p_value(3.0) == 1.0 and N.adf_p_value(-19.0) == 0.0


def test_conditional_squares_find_the_coefficients():
    rng = np.random.default_rng(3)
    e = rng.standard_normal(4000)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 1.0 + 0.6 * x[t - 1] + e[t] + 0.5 * e[t - 1]
    ar, ma, c, rest = N.css_fit(x, 1, 1)
    assert ar[0] == pytest.approx(0.6, abs=0.05) and ma[0] == pytest.approx(0.5, abs=0.05) and c == pytest.approx(1.0, abs=0.15)
    first = N.least_squares_ar(x, 1, 1)
    assert rest @ rest <= N.css_errors(x, first[0], first[1], first[2]) @ N.css_errors(x, first[0], first[1], first[2]) + 1e-9
    assert rest[100:] @ rest[100:] / 3900 == pytest.approx(1.0, abs=0.08)
    ahead = N.arima_forecast(x, 50)
    assert ahead[-1] == pytest.approx(2.5, abs=0.4)


def test_least_squares():
    x = np.column_stack([np.arange(20.0), np.ones(20)])
    beta, t, _ = N.ols(x, 3 * np.arange(20.0) + 1 + 0.01 * (-1) ** np.arange(20))
    assert np.allclose(beta, [3, 1], atol=0.01) and t[0] > 1000


def test_seasonal_island():
    values = np.array([10.0, 20, 30, 40] * 20 + [1.0] * 20 + [10.0, 20, 30, 40] * 20)
    assert np.flatnonzero(N.seasonal_outliers(values, (2, 2), "negative")).tolist() == [95]


def test_changes_are_one_sided(spark):
    rows = [("up", True, 10.0), ("up", False, 1.0), ("down", True, 1.0), ("down", False, 10.0), ("new", True, 5.0)]
    df = spark.createDataFrame(rows, "name string, recent boolean, value double")
    got = {r["name"]: (round(r["magnitude"], 6), r["significant"]) for r in K.change_significance(df, ["name"], "recent", "sum").collect()}
    assert got == {"up": (0.9, True), "down": (0.0, False), "new": (1.0, True)}


def test_a_failing_series_leaves_the_others(spark):
    both = series(spark, [1, 2, 30, 2, 1], "a").unionByName(series(spark, [-1, 2], "b"))

    def rule(values):
        if values[0] < 0:
            raise ValueError("no")
        return values > 10

    got = D._kernel(both, ["name"], rule)
    assert [r["is_anomaly"] for r in got.where("name = 'a'").orderBy("ts_ms").collect()] == [False, False, True, False, False]
    assert [r["is_anomaly"] for r in got.where("name = 'b'").collect()] == [None, None] and [r["name"] for r in D.failed(got, ["name"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        D.run_pool({"x": ("a", "iqr", {}, 0, "")}, both, ["name"])


# --- causes and advice ---------------------------------------------------------------------------


def test_label_weights_golden(spark):
    rows = [("a", [1, 1, 0]), ("a", [1, 0, 0]), ("b", [0, 1, 1])]
    got = {r["label"]: [round(w, 3) for w in r["weight"]] for r in A.label_weights(spark.createDataFrame(rows, "label string, pattern array<int>")).collect()}
    assert got == {"a": [0.667, 0.320, 0.013], "b": [0.039, 0.471, 0.490]}


def test_broadcasts_are_counted_first(spark):
    library = spark.createDataFrame([(1, [1], [1.0])] * 3, "label int, pattern array<int>, weight array<double>")
    asked = spark.createDataFrame([(1, [1])], "id int, features array<int>")
    assert [(r["label"], r["probability"]) for r in A.nearest_causes(asked, "id", library, most=3).collect()] == [(1, 1.0)]
    with pytest.raises(ValueError, match="more than 2 rows"):
        A.nearest_causes(asked, "id", library, most=2)


def test_grown_candidates_against_brute_force(spark):
    rng = random.Random(5)
    queries = [(i, f"t{i % 2}", rng.randint(1, 3), 1000.0, False) for i in range(12)]
    shares = {i: {c: rng.choice([0.1, 0.3, 0.9]) for c in rng.sample("abcd", rng.randint(1, 3))} for i in range(12)}
    q = spark.createDataFrame(queries, "query_id int, table_name string, freq int, rows double, writes boolean")
    p = spark.createDataFrame([(i, c, s) for i, cs in shares.items() for c, s in cs.items()], "query_id int, column string, share double")

    def cost(table, columns):
        total = 0.0
        for i, t, freq, rows, _ in queries:
            if t == table:
                for c in columns:
                    if c not in shares[i]:
                        break
                    rows *= shares[i][c]
                total += freq * max(1.0, rows)
        return total

    want = {}
    for t in ("t0", "t1"):
        known = sorted({c for i, x, *_ in queries if x == t for c in shares[i]})
        kept = [(c,) for c in known if cost(t, (c,)) < cost(t, ())]
        while kept:
            want |= {(t, k): cost(t, k) for k in kept}
            kept = [(*k, c) for k in kept for c in known if c not in k and len(k) < 5 and cost(t, (*k, c)) <= cost(t, k) * 0.95]
    got = {(r["table_name"], tuple(r["columns"])): r["cost"] for r in A.grown_candidates(q, p).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_greedy_takes_what_fits(spark):
    rows = [(1, 0, 1000.0, 1)] + [(1, k, 10.0 + k, 1) for k in range(1, 102)]
    cost = spark.createDataFrame(rows, "query_id int, config_id int, cost double, freq int")
    assert A.greedy(cost, 3, {k: (10.0 if k <= 100 else 1.0) for k in range(1, 102)}, 5.0) == [101]


def test_post_filter_keeps_what_fits(spark):
    cost = spark.createDataFrame([(1, 0, 100.0, 1), (1, 1, 10.0, 1), (1, 2, 20.0, 1), (1, 3, 99.0, 1), (1, 4, 100.0, 1)], "query_id int, config_id int, cost double, freq int")
    indexes = spark.createDataFrame([(k, float(k)) for k in range(1, 5)], "config_id int, storage double")
    ids = lambda **a: [r["config_id"] for r in A.post_filter(cost, indexes, **a).collect()]
    assert ids() == [1, 2] and ids(room=2.0) == [1] and ids(room=2.5, count=1) == [1] and ids(improved=0.0) == [1, 2, 3]


# --- texts ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("rule", "before", "after"),
    [
        (W.in_to_exists, "select a from t where b in (select c from u)", "select a from t where EXISTS (SELECT 1 FROM u WHERE u.c = t.b)"),
        (W.in_to_exists, "select a from t where b not in (select c from u)", None),
        (W.in_to_exists, "select a from t where b in (select c from u where d = 1 or e = 2)", None),
        (W.having_to_where, "select a, count(*) from t group by a having count(*) > 1", None),
        (W.having_to_where, "select a, count(*) from t where b = 1 group by a having a = 2 order by a", "select a, count(*) from t where b = 1 AND a = 2 GROUP BY a order by a"),
        (W.having_to_where, "select a, count(*) from t where b = 1 or c = 2 group by a having a = 2", None),
        (W.two_level_count, "select count(distinct a), b from t", None),
        (W.or_to_in, "select a from t where a = 1 or a = 2 and b = 3", None),
        (W.or_to_in, "select a from t where b = 3 and a = 1 or a = 2", None),
        (W.or_to_in, "select a from t where b = 3 and (a = 1 or a = 2) order by a", "select a from t where b = 3 and (a IN (1, 2)) order by a"),
        (W.or_to_in, "select a from t where c + a = 1 or a = 2", None),
        (W.or_to_in, "select a from t where a = 1 or a = 2 + b", None),
        (W.or_to_in, "select a from t where c = 5 or a = 1 or a = 2", "select a from t where c = 5 or a IN (1, 2)"),
        (W.free_column, "select a from t where a - b * 2 < 10", None),
        (W.free_column, "select a from t where c = 1 and a + 2 < 10", "select a from t where c = 1 and a < 10 - 2"),
        (W.free_column, "select a from t where x between y and a + 2 < 10", None),
        (W.drop_constant_order, "select a from t where b in (select x from u where c = 1) order by c", None),
        (W.drop_constant_order, "select a from t left join u on u.c = 1 order by c", None),
        (W.drop_constant_order, "select a from t where c = 1 or b = 2 order by c", None),
        (W.drop_constant_order, "select a from t where b > 2 and c = 'x y' order by c, d limit 3", "select a from t where b > 2 and c = 'x y' order by d limit 3"),
        (W.drop_constant_order, "select a from t where a + c = 1 order by c", None),
        (W.never_true, "select a from t where b > 3 and b <= 3 limit 1", "select a from t WHERE 1 = 0 limit 1"),
        (W.never_true, "select a from t where b >= 3 and b <= 3", None),
        (W.never_true, "select a from t where b > 3 or b < 1", None),
        (lambda s: W.drop_distinct(s, {"t"}), "select distinct * from t where a = 1", "select * from t where a = 1"),
        (lambda s: W.drop_distinct(s, {"t"}), "select distinct * from t join u on a = b", None),
    ],
)
def test_rewrites(rule, before, after):
    assert rule(before) == (after or before)


def test_similar_templates_are_weighted(spark):
    rows = [("SELECT A FROM T WHERE B = ?", 2.0, 50.0), ("SELECT A FROM T WHERE B = ? AND C = ? AND D = ?", 10.0, 60.0), ("SELECT A FROM ANOTHER_TABLE_WITH_A_LONG_NAME JOIN AND_YET_ANOTHER ON X = Y", 99.0, 70.0)]
    model = spark.createDataFrame(rows, "template string, mean double, expected double")
    texts = ["select a from t where b = 7 and c = 1", "select a from t where b = 12", "delete from v", " ", None]
    asked = spark.createDataFrame([(t,) for t in texts for _ in range(200)], "sql string")
    got = {r["sql"]: (r["seconds"], r["status"]) for r in Q.predict_duration(asked, model, "sql", 2).collect()}
    near, far = 1 / 10, 1 / 10  # ten characters more, ten less
    assert got["select a from t where b = 7 and c = 1"] == (pytest.approx((near * 2 + far * 10) / (near + far)), "No SQL template found")
    assert got["select a from t where b = 12"] == (50.0, "Fine match")
    assert got["delete from v"] == (None, "No SQL information") and got[" "] == (None, "Suspect illegal sql") and len(got) == 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(above + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_nearest_texts_equal_all_comparisons(spark, chunk):
    rng = random.Random(5)
    words = ["select a from t", "where b = ?", "and c = ?", "order by d", "join u on x = y", "x", "", "ab", "abab", "ßé"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    known = [("s", text()) for _ in range(60)] + [("o", t) for t in ("", "a", "zz")] + [("s", "hot")] * 500 + [("s", None)]
    asked = [("s", t[:-2] + rng.choice(["", "q", "qq"])) for _, t in known[:30]] + [("s", text()) for _ in range(20)] + [("o", "b"), ("none", "b"), ("s", None)] + [("s", "hut")] * 500
    for equal in (True, False):
        got = similarity.nearest(spark.createDataFrame(asked, "head string, text string").repartition(3), spark.createDataFrame(known, "head string, text string"), 3, equal=equal, chunk=chunk)
        want = []
        for h, t in {x for x in asked if x[1] is not None}:
            near = sorted((edits(t, s), s) for g, s in set(known) if g == h and s is not None and (equal or s != t))
            want += [(h, t, s, d) for d, s in near if d <= near[min(2, len(near) - 1)][0]]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_own_costs(spark):
    plan = "Hash Join  (cost=0.00..100.00 rows=1 width=8)\n  ->  Seq Scan on a  (cost=0.00..40.00 rows=1 width=8)\n  ->  Sort  (cost=25.00..30.00 rows=1 width=8)\n        ->  Seq Scan on b  (cost=5.00..25.00 rows=1 width=8)"
    tree = Q.own_cost(Q.plan_tree(Q.plan_nodes(spark.createDataFrame([(1, plan)], "id int, plan string"), "id", "plan"), "id"), "id")
    # The join begins before its scans end: less the latest start of a child; the sort begins when its scan has ended: less the scan.
    assert [r["own_cost"] for r in tree.orderBy("node").collect()] == [75.0, 40.0, 5.0, 25.0]


def test_conjunctions(spark):
    rows = [(1, "a", ">", 3.0), (1, "a", "<", 3.0), (2, "a", ">=", 3.0), (2, "a", "<=", 3.0), (3, "a", "=", 3.0), (3, "a", "<>", 3.0), (4, "a", ">", 3.0), (4, "b", "<", 1.0), (5, "a", "=", 1.0), (5, "a", "=", 2.0), (6, "a", ">=", 1.0), (6, "a", ">", 1.0), (6, "a", "<=", 1.0)]
    terms = spark.createDataFrame(rows, "rule int, column string, op string, value double")
    assert sorted(r["rule"] for r in P.impossible(terms).collect()) == [1, 3, 5, 6]
    branches = terms.withColumn("branch", F.col("rule")).withColumn("rule", F.lit(0))
    assert sorted(r["branch"] for r in P.alternatives(branches).collect()) == [2, 4]


def test_exact_percentiles(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([float(rng.randint(0, 5)), rng.random() * 100, None])) for g in "aabbc" for _ in range(rng.randint(1, 400))] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        want = {g: np.percentile(v, 100 * q) for g in "abc" if (v := [x for k, x in rows if k == g and x is not None])} | {"one": 3.0}
        got = {r["g"]: r["percentile"] for r in R.exact_percentile(df, ["g"], "x", q, parts=7).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g]) for g in want)


def test_subsets_are_bounded(spark):
    df = spark.createDataFrame([(1, x) for x in "abc"] + [(2, x) for x in "abcde"], "k int, m string")
    got = {tuple(r["members"]) for r in R.subsets(df.where("k = 1"), "k", "m").collect()}
    assert got == {c for n in range(4) for c in itertools.combinations("abc", n)}
    with pytest.raises(Exception, match="more than 4 members"):
        R.subsets(df, "k", "m").collect()


# --- helpers -------------------------------------------------------------------------------------


def test_kept_results_expire():
    now, calls = [0.0], []

    @kept.ttl_cache(10, most=2, clock=lambda: now[0])
    def double(x, *, plus=0):
        calls.append(x)
        if x < 0:
            raise ValueError
        return 2 * x + plus

    assert [double(1), double(1), double(1, plus=1)] == [2, 2, 3] and calls == [1, 1]
    now[0] = 10.0
    assert double(1) == 2 and calls == [1, 1, 1] and len(double.kept) == 1
    double(2), double(3)
    assert len(double.kept) == 2
    for _ in range(2):
        with pytest.raises(ValueError):
            double(-1)
    assert kept.first_that_works(lambda: 1 / 0, lambda: None, lambda: 3) == 3 and kept.first_that_works(lambda: None) is None
    with pytest.raises(ZeroDivisionError):
        kept.first_that_works(lambda: None, lambda: 1 / 0)


# --- stores and streams --------------------------------------------------------------------------


def test_only_gaps_are_fetched(spark, tmp_path):
    asked = []

    def fetch(gaps):
        asked.extend((r["name"], r["start_ms"], r["end_ms"]) for r in gaps.collect())
        return gaps.select("name", F.explode(F.sequence("start_ms", "end_ms", F.lit(10).cast("long"))).alias("ts_ms")).withColumn("value", F.col("ts_ms").cast("double"))

    cache = store.SeriesCache(spark, str(tmp_path / "cache"), ["name"], 10, fetch)
    a = spark.createDataFrame([("a",)], "name string")
    both = spark.createDataFrame([("a",), ("b",)], "name string")
    assert cache.get(a, 23, 41, 1).count() == 4 and asked == [("a", 20, 50)]
    asked.clear()
    assert cache.get(a, 30, 40, 2).count() == 2 and asked == []
    assert cache.get(both, 0, 70, 3).count() == 16 and sorted(asked) == [("a", 0, 10), ("a", 60, 70), ("b", 0, 70)]
    asked.clear()
    pruned = cache.prune(2)
    assert pruned.get(a, 0, 70, 4).count() == 8 and asked == [("a", 20, 50)]


def test_a_second_write_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (3, 4, "y")], "hash1 int, hash2 int, query string")
    for _ in range(2):
        store.record(rows, str(tmp_path), "slow_queries")
    assert store.read(spark, str(tmp_path), "slow_queries").count() == 2
    kept = store.retain(spark, str(tmp_path), "slow_queries", "hash1", 2)
    assert [r["query"] for r in spark.read.parquet(kept).collect()] == ["y"]


def test_the_buffer_of_seen_statements_is_bounded(spark, tmp_path):
    rows = [("i", f"q{k}", k) for k in (1, 2, 3, 1, 4, 5, 1)]
    rows = [(g, q, t) for t, (g, q, _) in enumerate(rows)] + [("j", "q1", 0), ("j", "q1", 100)]
    for k in range(2):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5] if k == 0 else rows[5:], "instance string, query string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("instance string, query string, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = L.bounded_seen(stream, "instance", "query", "t", most=3, expiry_ms=50)
    q = seen.writeStream.format("memory").queryName("bounded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["instance"], r["identity"], r["time_ms"]) for r in spark.table("bounded").collect())
    # Of i the first of the last three leaves when a fourth comes, so that q1 is new again; of j the same statement expires.
    assert got == [("i", "q1", 0), ("i", "q1", 6), ("i", "q2", 1), ("i", "q3", 2), ("i", "q4", 4), ("i", "q5", 5), ("j", "q1", 0), ("j", "q1", 100)]


def test_recurrence_over_ranges_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    long, short = np.cumsum(rng.normal(size=120_000)), rng.normal(size=5)
    rows = pd.DataFrame({"name": ["long"] * len(long) + ["short"] * 5 + ["one"], "ts_ms": [*range(0, 10 * len(long), 10), *range(5), 7], "value": [*long, *short, 3.0]}).sample(frac=1, random_state=1)
    for period in (7, 24):
        got = recurrence.holt_winters(spark.createDataFrame(rows), ["name"], 0.2, 0.1, 0.3, period, parts=9).toPandas().sort_values("ts_ms")
        for name, values in (("long", long), ("short", short), ("one", np.array([3.0]))):
            mine = got[got["name"] == name]["value"].to_numpy()
            assert np.allclose(mine, N.holt_winters(values, 0.2, 0.1, 0.3, period), atol=1e-6)


def test_indexes_of_several_types(spark):
    rows = [("t", "a", "", 1.0), ("t", "a,b", "local", 2.0), ("t", "a,b", "global", 2.0), ("t", "a,b,c", "", 1.0), ("t", "b", "global", 5.0), ("t", "b,c", "local", 5.0), ("t", "c", "", 1.0), ("u", "a,b", "", 3.0), ("u", "ab", "", 1.0)]
    got = A.distinct_types(spark.createDataFrame(rows, "table_name string, columns string, index_type string, benefit double"))
    assert sorted(map(tuple, got.collect())) == [("t", "a,b", "global", 2.0), ("t", "b", "global", 5.0), ("t", "c", "", 1.0), ("u", "a,b", "", 3.0), ("u", "ab", "", 1.0)]


def test_best_sets_equal_all_sets(spark):
    rng = random.Random(9)
    cost = [(q, 0, 100.0, q % 3 + 1) for q in range(20)] + [(q, c, rng.choice([100.0, 60.0, 30.0, 5.0]), q % 3 + 1) for q in range(20) for c in range(1, 9)]
    size = {c: float(rng.randint(1, 4)) for c in range(1, 9)}
    table = {(q, c): v for q, c, v, _ in cost}
    gain = lambda s: sum((100 - min([100.0, *(table[q, c] for c in s)])) * (q % 3 + 1) for q in range(20))
    sets = [s for k in range(9) for s in itertools.combinations(range(1, 9), k) if sum(size[c] for c in s) <= 7]
    best = max(sets, key=lambda s: (gain(s), -len(s), tuple(-c for c in s)))
    df = spark.createDataFrame(cost, "query_id int, config_id int, cost double, freq int")
    assert A.search_sets(df, size, 7.0, walks=256) == (list(best), pytest.approx(gain(best)))
    assert A.search_sets(df, size, 0.5) == ([], 0.0)


def test_joint_conditions(spark):
    """Verdicts too old do not count, several series of the other metric are told apart, an alarm may begin in the forecast."""
    rows = [("m", 1, "a", t, 10.0) for t in range(0, 100, 10)] + [("o", 1, "x", t, 5.0) for t in (0, 30)] + [("o", 1, "y", t, 1.0) for t in range(0, 100, 30)] + [("m", 2, "a", 0, 10.0)]
    df = spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows], "metric string, host int, series string, ts_ms long, value double")
    both = [conditions.Condition("m", "threshold", 10, {"high": 9.0}), conditions.Condition("o", "threshold", 30, {"high": 4.0})]
    found = conditions.together(df, both, "host", tolerance_ms=20)
    hits = {(r["others"][0], r["ts_ms"]) for r in found.where("hit").collect()}
    assert hits == {("x", t) for t in (0, 10, 20, 30, 40, 50)} and found.where("host = 2").count() == 0
    rising = spark.createDataFrame([("m", 1, "a", t, float(t)) for t in range(0, 100, 10)], "metric string, host int, series string, ts_ms long, value double")
    alarm = conditions.joint_alarms(conditions.together(rising, [conditions.Condition("m", "threshold", 10, {"high": 95.0})], "host", 0, ahead_ms=50), "host", 30, "c").first()
    assert (alarm["start_ms"], alarm["end_ms"], alarm["n"], alarm["foreseen"]) == (100, 140, 5, True)


def test_bent_numbers_are_stationary_and_come_back():
    rng = np.random.default_rng(5)
    for n in range(1, 6):
        free = rng.normal(scale=2, size=n)
        assert N.stable(N.from_free(free), np.zeros(0)) and np.allclose(N.to_free(N.from_free(free)), free, atol=1e-6)
    assert N.from_free(N.to_free(np.array([0.5, 0.3]))) == pytest.approx([0.5, 0.3])


def simulated(ar, ma, n, seed):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(max(len(ar), len(ma)), n + 200):
        x[t] = 1.0 + sum(a * x[t - k - 1] for k, a in enumerate(ar)) + e[t] + sum(m * e[t - k - 1] for k, m in enumerate(ma))
    return x[200:]


def test_orders_and_coefficients_are_recovered(spark):
    truth = {"ar2": ([0.6, -0.4], []), "ma1": ([], [0.7]), "arma": ([0.7], [0.4]), "ar3": ([0.4, 0.0, 0.4], [])}
    rows = [(name, t, float(v)) for k, (name, (ar, ma)) in enumerate(truth.items()) for t, v in enumerate(simulated(ar, ma, 1500, k))]
    rows += [("short", t, float(t % 2)) for t in range(3)] + [("level", t, 3.0) for t in range(50)] + [("walk", t, float(v)) for t, v in enumerate(np.cumsum(np.random.default_rng(1).normal(size=400)))]
    best = arima.best_orders(spark.createDataFrame(rows, "name string, ts_ms long, value double"), ["name"])
    got = {r["name"]: r for r in best.collect()}
    for name, (ar, ma) in truth.items():
        r = got[name]
        assert (r["d"], r["p"], r["q"]) == (0, len(ar), len(ma)), name
        assert np.allclose(r["ar"], ar, atol=0.09) and np.allclose(r["ma"], ma, atol=0.09)
    assert got["walk"]["d"] == 1 and got["short"]["bic"] is None
    ahead = {(r["name"], r["step"]): r["value"] for r in arima.forecast(best, ["name"], 3).collect()}
    assert [ahead["level", k] for k in (1, 2, 3)] == [3.0] * 3 and ahead["short", 1] == pytest.approx(1 / 3) and len(ahead) == 21


def test_swarm_over_rows(spark):
    rows = spark.range(2000).select((F.col("id") / 1000).alias("u"), (F.col("id") / 500 + 0.5).alias("v"))
    point, cost = A.swarm(rows, lambda x: (F.col("v") - x[0] * F.col("u") - x[1]) ** 2, [-5, -5], [5, 5], particles=12, rounds=40, seed=1)
    assert point == pytest.approx([2.0, 0.5], abs=0.02) and cost < 1e-4
    assert A.swarm(rows.where("u < 0"), lambda x: F.col("v") * x[0], [0.0], [2.0]) == ([1.0], math.inf)

def test_hosts_equal_each_sample_compared(spark):
    """Ranges of a statement are looked up; a group that many ask is dealt to several tasks; NaN is largest, NULL none, and a row does not vanish."""
    rng = random.Random(5)
    samples = [(rng.randint(0, 1), rng.choice("ab"), rng.randint(0, 3000), rng.choice([None, math.nan, *(rng.random() for _ in range(8))])) for _ in range(400)]
    asked = [(k, rng.randint(0, 2), rng.randint(0, 3000), rng.choice([0, 1, 50, 900, 2500])) for k in range(200)]
    s = spark.createDataFrame(samples, "instance int, name string, ts_ms long, value double")
    a = spark.createDataFrame([*asked, (None, 1, 5, 5), (900, None, 5, 5), (901, 1, None, 5)], "id long, instance int, start_ms long, duration_ms long")
    got = {r["id"]: {k: str(v) for k, v in r["host"].items()} for r in causes.host_facts(a, s, bucket_ms=1000, asked_at_once=7).collect()}
    largest = lambda found: str(max(found, key=lambda v: (math.isnan(v), v)))
    want = {}
    for k, instance, start, length in asked:
        met = {n: [v for i, name, at, v in samples if (i, name) == (instance, n) and v is not None and start <= at <= start + length] for n in "ab"}
        if any(met.values()):
            want[k] = {n: largest(v) for n, v in met.items() if v}
    assert got == want


def test_hosts_take_no_row_for_each_pair(spark):
    """2,000 statements that each meet all of 40,000 samples: 80 million pairs, of which none is made."""
    s = spark.range(40_000).selectExpr("1 AS instance", "'a' AS name", "id AS ts_ms", "cast(id as double) AS value")
    a = spark.range(2_000).selectExpr("id", "1 AS instance", "id AS start_ms", "50000L AS duration_ms")
    began = time.time()
    found = causes.host_facts(a, s)
    assert found.where("host['a'] = 39999").count() == 2_000
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().partition("CoGroup")[0] and time.time() - began < 60


def test_causes_of_many_kinds_equal_each_pair(spark):
    rng = np.random.default_rng(3)
    kinds = [(k, rng.integers(0, 2, 6).tolist()) for k in range(40)] + [(900, [1, 1]), (901, None), (902, [1, None, 1, 1, 1, 1])]
    library = [(int(rng.integers(0, 3)), rng.integers(0, 2, 6).tolist(), rng.random(6).round(3).tolist()) for _ in range(50)] + [(7, [1] * 6, [None] * 6), (8, [0, 1], [1.0, 0.5]), (9, None, None)]
    asked = spark.createDataFrame(kinds, "kind int, features array<int>")
    known = spark.createDataFrame(library, "label int, pattern array<int>, weight array<double>")
    rows = lambda df: sorted((r["kind"], r["label"], round(r["probability"], 9)) for r in df.collect())
    assert rows(A.kind_causes(asked, "kind", known, chunk=9)) == rows(A.nearest_causes(asked, "kind", known))


def test_a_library_may_have_more_rows_than_a_broadcast_is_for(spark):
    """10,001 patterns: nearest_causes() refuses them."""
    known = spark.range(10_001).selectExpr("1 AS label", "array(cast(id as int), 1) AS pattern", "array(1.0D, 1.0D) AS weight")
    assert [(r["label"], r["probability"]) for r in A.kind_causes(spark.createDataFrame([(1, [1, 0])], "kind int, features array<int>"), "kind", known).collect()] == [(1, 1.0)]


def test_coverage_prices_sets_without_the_workload(spark):
    """However many queries, as many rows as orders of configurations occur; any set's savings equal the sum over all queries."""
    rng = random.Random(11)
    kinds = [[(c, rng.choice([100.0, 70.0, 70.0, 40.0, 120.0])) for c in rng.sample(range(1, 7), rng.randint(0, 4))] for _ in range(8)]
    cost = [(q, 0, 100.0, q % 3 + 1) for q in range(3000)] + [(q, c, v, q % 3 + 1) for q in range(3000) for c, v in kinds[q % 8]]
    df = spark.createDataFrame(cost, "query_id int, config_id int, cost double, freq int")
    covers = A.coverage(df).collect()
    assert len(covers) <= sum(map(len, kinds))
    for s in itertools.chain.from_iterable(itertools.combinations(range(1, 7), k) for k in range(7)):
        want = sum(max([0.0, *(100 - v for c, v in kinds[q % 8] if c in s)]) * (q % 3 + 1) for q in range(3000))
        assert sum(r["saved"] for r in covers if set(r["any_of"]) & set(s)) == pytest.approx(want)


def test_texts_that_share_all_grams_are_not_met_on_each(spark, monkeypatch):
    """1,200 templates of the same words: a text meets nearly all of them on many grams, and is compared with all of them instead."""
    known = [("s", f"SELECT C{k % 5}, D{k % 8} FROM T{k % 30}_X WHERE A = ? AND B = ?") for k in range(1200)]
    asked = [("s", f"SELECT C9Z, D{k % 8} FROM T{k % 30}_X WHERE A = ? AND B = ? AND F = ?") for k in range(240)]
    compared, plainly = [], similarity._all
    monkeypatch.setattr(similarity, "_all", lambda rest, *more: compared.append(rest.count()) or plainly(rest, *more))
    got = similarity.nearest(*(spark.createDataFrame(x, "head string, text string") for x in (asked, known)), 3)
    want = [(h, t, s, d) for h, t in set(asked) for near in [sorted((edits(t, s), s) for _, s in set(known))] for d, s in near if d <= near[2][0]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(compared[:4]) == len(set(asked))  # none of them in the round of radius 16, after one in which nearly all pairs met


def test_distances_to_many_texts_at_once(spark):
    rng = random.Random(2)
    drawn = lambda most: "".join(rng.choice("abé😀") for _ in range(rng.randint(0, most)))
    known, asked = sorted({drawn(80) for _ in range(60)}), sorted({drawn(64) for _ in range(20)} | {"", "a" * 64})
    for k, equal in itertools.product((1, 3, 500), (True, False)):
        found = similarity._nearest_of(pa.table({"head": ["h"] * len(asked), "text": asked}), pa.table({"known": known}), k, equal).to_pylist()
        for t in asked:
            d = {x: edits(t, x) for x in known if equal or x != t}
            kth = sorted(d.values())[min(k, len(d)) - 1]
            assert {r["known"]: r["distance"] for r in found if r["text"] == t} == {x: n for x, n in d.items() if n <= kth}


def test_plan_facts_are_never_broadcast(spark):
    """Operators of a plan come from an explode, which Spark sizes as the plans."""
    facts = causes.plan_facts(spark.createDataFrame([(1, "Sort  (cost=1.00..2.00 rows=1 width=8)\n  ->  Seq Scan on a  (cost=0.00..1.00 rows=1 width=8)"), (2, None)], "id int, plan string"))
    assert [r["id"] for r in facts.collect()] == [1]
    assert "Broadcast" not in facts._jdf.queryExecution().executedPlan().toString()
